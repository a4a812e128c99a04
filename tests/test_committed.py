"""Files that appear with the job's commit."""

import os

import pytest
from pyspark.sql import functions as F

from plyframe.sources import committed, files


def listed(folder):
    return {os.path.relpath(os.path.join(b, n), folder): open(os.path.join(b, n), "rb").read() for b, _, names in os.walk(folder) for n in names if "/.pending-" not in b}


def test_all_rows_become_files(spark, tmp_path):
    rows = [(f"a/{i}.txt", f"text {i}") for i in range(40)] + [("none", None), ("empty", "")]
    committed.write_files(spark.createDataFrame(rows, "name string, content string").repartition(5), str(tmp_path / "out"))
    assert listed(tmp_path / "out") == {n: t.encode() for n, t in rows if t is not None}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 60, 1, 6).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 47, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        committed.write_files(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == {}


@pytest.mark.parametrize("parts", [1, 4])
def test_a_repeated_name_is_an_error_and_leaves_nothing(spark, tmp_path, parts):
    rows = spark.createDataFrame([("same", "1"), ("other", "2"), ("same", "3")], "name string, content string").repartition(parts, "content")
    with pytest.raises(Exception):
        committed.write_files(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == {}


def test_existing_files_and_odd_names(spark, tmp_path):
    one = lambda name, text: spark.createDataFrame([(name, text)], "name string, content string")
    out = str(tmp_path / "out")
    committed.write_files(one("f", "old"), out)
    with pytest.raises(Exception):
        committed.write_files(one("f", "new"), out)
    committed.write_files(one("f", "new"), out, replace=True)
    for name in ("../outside", "/etc/x"):
        with pytest.raises(Exception):
            committed.write_files(one(name, "x"), out)
    assert listed(tmp_path) == {"out/f": b"new"}


def test_a_killed_and_retried_task_is_there_once(tmp_path):
    """Spark counts one attempt of a task; another's files never appear."""
    writer = committed.FolderWriter(str(tmp_path), False)

    def killed():
        yield "a", b"1"
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    slow, good, other = writer.write(iter([("a", b"1")])), writer.write(iter([("a", b"1"), ("b", b"2")])), writer.write(iter([("c", b"3")]))
    assert listed(tmp_path).keys().isdisjoint({"a", "b", "c"})
    writer.commit([good, other])
    assert listed(tmp_path) == {"a": b"1", "b": b"2", "c": b"3"} and slow.files == 1


def test_records_with_their_tags(spark, tmp_path):
    games = spark.createDataFrame([("round7_game1", "[Event \"x\"]\n\n", "1. a b\n", "1. a\n", "\n")], "name string, tags string, beam_pgn string, raw_pgn string, legal_pgn string")
    files.write_records(games, str(tmp_path / "pgn"))
    assert listed(tmp_path / "pgn") == {"round7_game1_beam.pgn": b'[Event "x"]\n\n1. a b\n', "round7_game1_raw.pgn": b'[Event "x"]\n\n1. a\n', "round7_game1_legal.pgn": b'[Event "x"]\n\n\n'}
