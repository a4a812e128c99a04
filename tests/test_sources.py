import json

from plyframe.sources import files
from plyframe.streaming import batches


def test_small_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("filename,label\n a.png , 11x \nb.png,zz\n")
    (tmp_path / "c.json").write_text(json.dumps(["11", "11x", "empty"]))
    (tmp_path / "r.tsv").write_text("halfmoves\t1\ntotals\t81\t81\nhalfmove\tplayer\tmove\n1\tP1\t98\t10\t0\t80\t72\t-1\t-1\tongoing\n")
    for name in ("a.jpg", "a_split.jpg", "b.png"):
        (tmp_path / name).write_bytes(b"x")
    classes = files.class_list_json(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in classes.collect()] == [(0, "11"), (1, "11x"), (2, "empty")]
    assert [tuple(r) for r in files.labels_csv(spark, str(tmp_path / "l.csv"), classes).collect()] == [("a.png", "11x")]
    row = files.replay_tsv(spark, str(tmp_path / "r.tsv")).first()
    assert (row.halfmove, row.move, row.p1_kazan, row.winner) == (1, "98", 10, "ongoing")
    assert [r.path.rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).collect()] == ["a.jpg"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("raw", "1. 98\n"), ("beam", "1. 98 22\n")], "kind string, pgn string")
    files.write_pgn(df, str(tmp_path / "pgn"))
    assert sorted(p.name for p in (tmp_path / "pgn").iterdir() if p.is_dir()) == ["kind=beam", "kind=raw"]
    files.write_documents(df, str(tmp_path / "doc"))
    assert {json.loads(r.value)["kind"] for r in spark.read.text(str(tmp_path / "doc")).collect()} == {"raw", "beam"}


def test_stream_of_batches(spark, tmp_path):
    for k in range(3):
        spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = batches.events_in_batches(spark, str(tmp_path / "in"), "id long", lambda df, n: seen.append((n, df.count())), str(tmp_path / "check"))
    query.awaitTermination(90)
    assert [n for _, n in seen] == [5, 5, 5]
