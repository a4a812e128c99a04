"""Requests through the gate and pages to records, in a batch and as a stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.operators import convert, gate, reading
from plyframe.sources.files import png_bytes
from plyframe.streaming import batches
from tests.test_pages import _df
from tests.test_reading import _inked, _says

REQUESTS = "request string, meta_text string, games_text string, beam_choice string, images array<int>"
ROWS = [
    ("ok", 'Open,"Almaty, hall",2024-01-02,07', 'Aru,Bek,1,1:05\n\n "Cem ""C"" D" ,,1/2-1/2,,0:50', "many", [0, 1, 2]),
    ("long meta", "a,b,c,1,e", "", "1024", [3]),
    ("round", "a,b,c,x", "", "1024", [3]),
    ("round 21", "a,b,c,21", "", "1024", [3]),
    ("lines", "", "a\nb\nc", "1024", [3]),
    ("fields", "", "a\nb,c,1,d,e,f", "1024", [3, 4]),
    ("result", "", "a,b,DRAW", "1024", [3]),
    ("none", "", "", "1024", []),
    ("six", "", "", "1024", [3, 4, 5, 6, 7, 8]),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(ROWS, REQUESTS)


def test_first_errors_by_name(requests):
    got = {r.request: (r.code, r.line, r.got) for r in gate.refused(requests).collect()}
    assert got == {
        "long meta": ("meta_fields", None, "5"),
        "round": ("round_not_number", None, "x"),
        "round 21": ("round_range", None, "21"),
        "lines": ("game_lines", None, "3"),
        "fields": ("game_fields", 2, "6"),
        "result": ("game_result", 1, "DRAW"),
        "none": ("no_images", None, "0"),
        "six": ("too_many_images", None, "6"),
    }


def test_admitted_images_have_all_tags(requests):
    got = {r.n: r for r in gate.admitted(requests).collect()}
    assert [got[n].name for n in (1, 2, 3)] == ["round7_game1", "round7_game2", "round7_game3"] and {r.width for r in got.values()} == {2048}
    head = '[Event "Open"]\n[Site "Almaty, hall"]\n[Date "2024-01-02"]\n[Round "7"]\n'
    assert got[1].tags == head + '[White "Aru"]\n[Black "Bek"]\n[Result "1-0"]\n[WhiteClock "1:05"]\n\n'
    assert got[2].tags == head + '[White "Cem "C" D"]\n[Black "?"]\n[Result "1/2-1/2"]\n[BlackClock "0:50"]\n\n'
    assert got[3].tags == head + '[White "?"]\n[Black "?"]\n[Result "*"]\n\n'
    assert [got[n].result for n in (1, 2, 3)] == [0, -1, None]


def test_only_admitted_pages_are_read_and_records_are_written(spark, requests, tmp_path):
    asked = requests.filter("request in ('ok', 'six', 'result')").withColumn("beam_choice", F.lit("3"))
    scans = _df(spark, [_inked(3), np.full((60, 60), 255, np.uint8)]).selectExpr("int(id) as sheet", "image")
    scans = scans.unionByName(scans.limit(1).selectExpr("3 as sheet", "image"))
    store = str(tmp_path / "p")
    done = convert.convert(asked, scans, _says(reading.MOVE_CLASSES, "99"), store, views=False).cache()
    rows = {(r.request, r.n): r for r in done.collect()}
    assert {k[0] for k in rows} == {"ok", "six", "result"} and rows["six", None].error == "too_many_images 6" and rows["result", None].error == "game_result line 1 DRAW"
    assert {r.sheet for r in spark.read.parquet(store).select("sheet").distinct().collect()} == {0, 1}
    assert rows["ok", 1].error is None and rows["ok", 1].plies == 3 and rows["ok", 1].stopped.startswith("empty cell")
    assert rows["ok", 2].error == "found 0 tables, need 8" and rows["ok", 3].error == "no such image"
    convert.write_records(done, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out" / "ok")) == [f"round7_game1_{k}.pgn" for k in ("beam", "legal", "raw")]
    text = (tmp_path / "out" / "ok" / "round7_game1_beam.pgn").read_text()
    assert text.startswith('[Event "Open"]') and text.endswith(rows["ok", 1].beam_pgn) and "\n\n1. " in text


def test_a_stream_of_pages_with_a_broken_file(spark, tmp_path):
    folder, out, store = (str(tmp_path / n) for n in ("in", "out", "store"))
    os.makedirs(folder)
    for name in ("a.png", "b.png"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(png_bytes(np.full((40, 40), 200 if name == "a.png" else 90, np.uint8)))
    with open(f"{folder}/broken.png", "wb") as f:
        f.write(b"no image at all")
    moves = _says(reading.MOVE_CLASSES, "99")
    run = lambda: batches.pages_in_batches(spark, folder, moves, out, store, str(tmp_path / "check"), "*.png", width=1, views=False).awaitTermination()
    run()
    rows = lambda: {os.path.basename(r.sheet): (r.error, r.batch) for r in spark.read.parquet(out).collect()}
    first = rows()
    assert {n: e for n, (e, _) in first.items()} == {"a.png": "found 0 tables, need 8", "b.png": "found 0 tables, need 8", "broken.png": "unreadable image"}
    assert len({b for _, b in first.values()}) == 3
    # A batch that is run again replaces its own rows.
    again = spark.read.format("binaryFile").load(f"{folder}/a.png").select("path")
    batches.page_batch(moves, out, store, width=1, views=False)(again, first["a.png"][1])
    assert rows() == first and spark.read.parquet(out).count() == 3
    with open(f"{folder}/late.png", "wb") as f:
        f.write(png_bytes(np.full((30, 30), 10, np.uint8)))
    run()
    assert len(rows()) == 4 and {k: v for k, v in rows().items() if k != "late.png"} == first
