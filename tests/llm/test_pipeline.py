"""All five stages on awkward rows, each against a plain version of what it decides."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plyframe.llm import language_id, packing
from plyframe.llm._shared import WHITE

from .test_operators import near_truth, norm

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real documents with nulls, ties, repeated rows and a long text among them."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in real.collect()]
    clean = next(r for r in rows if r.lang == "en" and len(r.text) > 1500) if hasattr(rows[0], "lang") else next(r for r in rows if r[2] == "en" and len(r[1]) > 1500)
    extra = [
        (5001, None, None, None, None),
        (5002, "", "en", None, 0),
        (None, clean[1], "en", "web", 1),
        (5003, clean[1], "en", "web", 1),
        (5003, clean[1], "en", "web", 1),
        (5004, clean[1].replace(" ", "  "), "en", "web", 1),
        (5005, " ".join(clean[1].split()[:-3]), "en", "web", 1),
        (5006, (clean[1] + " ") * 40, "en", "web", 1),
        (5007, "12345 !!!", None, "web", 9),
    ]
    spark.createDataFrame(rows + extra, real.schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.select(COLUMNS).collect()]
        docs = cp.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == COLUMNS
        after = [tuple(r) for r in docs.select(COLUMNS).collect()]
        kept[name] = (before, after)
    before, after = kept["language_id"]
    letters = re.compile(r"[^\W\d_]")
    assert all(letters.search(r[1] or "") for r in after)
    assert sum(bool(letters.search(r[1] or "")) for r in before) - len(after) <= 0.02 * len(before)

    before, after = kept["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(norm(r[1]), []).append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(repr, after)) == sorted(map(repr, best))

    before, after = kept["near_dedup"]
    _, parts = near_truth([(r[0], r[1]) for r in before])
    assert sorted(repr(r[0]) for r in after) == sorted(repr(g) for g in set(parts))

    before, after = kept["mixing"]
    words = lambda rs: sum(len(re.findall(f"[^{WHITE}]+", r[1] or "")) for r in rs)
    assert {r[0] for r in after} <= {r[0] for r in before}
    assert abs(words(after) - words(before)) <= 0.02 * words(before) + 10
    times = {}
    for r in after:
        times[r[0]] = times.get(r[0], 0) + 1
    assert max(times.values()) <= 4

    pieces = cp.STAGES[-1][1](spark, docs, folder).collect()
    encode = packing.encoder(*packing.tokenizer_paths())
    assert sum(r.length for r in pieces) == sum(len(encode(r[1] or "")) + 1 for r in after)
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark):
    rows = [(i, f"the cat number {i} sat on the mat and looked at the big dog again", "en", "s", i, "r", "k", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, rep string, `key` string, words int")
    for stage in (cp.drop_copies, cp.drop_near_copies, cp.mix_sources):
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "id", "rep", "key", "words"]
    model = language_id.train(docs, F.lit(True))
    assert language_id.keep_identified(docs, model, min_score=0.0).columns == docs.columns
