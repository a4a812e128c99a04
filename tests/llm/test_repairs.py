"""Spill accounts, repeated and null page ids, altered payloads, hot hashes."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plyframe.llm import _sorted_runs, exact_dedup, substring_dedup, warc

from .test_operators import prose


def test_spill_account_returns_to_what_is_left():
    rng = random.Random(7)
    owner = exact_dedup._Owner(60_000)
    for i in range(6000):
        key = bytes(rng.choices(b"abcd", k=rng.randint(0, 9)))
        owner.add(key, (len(key), i, i), 1, [i] * rng.randint(1, 5))
        nodes, stack = 0, [owner.trie.root]
        if i % 500 == 499:
            while stack:
                x = stack.pop()
                nodes += exact_dedup.NODE_BYTES + len(x.label) + (exact_dedup.MEMBER_BYTES * len(x.item[2]) if x.item else 0)
                stack += (x.kids or {}).values()
            # The root's own bytes are not counted; a split label keeps its length.
            assert abs(owner.trie.size - nodes) <= exact_dedup.NODE_BYTES
    assert len(owner.files) <= exact_dedup.MOST_FILES
    assert sum(len(item[2]) for _, item in owner.groups()) > 6000


def test_repeated_and_null_page_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (2, None, None), (3, "e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r) for r in warc.page_records(warc.read_archives(warc.write_archives(pages))).collect()]
    assert len(got) == len(rows)
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    of = lambda text: sorted(repr((r[0], r[3], r[4])) for r in got if r[2] == digest(text))
    assert of("same") == sorted(map(repr, [(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1)]))
    assert of("alone") == sorted(map(repr, [(None, "response", None), (None, "revisit", None)]))
    assert of("") == sorted(map(repr, [(3, "response", None), (2, "revisit", 3)]))


def test_an_altered_payload_raises(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    for name, body in (("good", b"payload"), ("bad", b"paXload")):
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(gzip.decompress(warc.record_bytes("response", "1", "u", body, digest, 7, None))))
    listed = warc.list_archives(spark, str(tmp_path)).filter(F.col("path").contains("good"))
    assert warc.page_records(warc.read_archives(listed)).count() == 1
    with pytest.raises(Exception, match="does not agree"):
        warc.page_records(warc.read_archives(warc.list_archives(spark, str(tmp_path)))).collect()


@pytest.mark.parametrize("most", [0, 200_000])
def test_a_hash_that_most_rows_have(spark, monkeypatch, most):
    monkeypatch.setattr(_sorted_runs, "MOST_BROADCAST", most)
    monkeypatch.setattr(_sorted_runs, "HOLD", 50)
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).cast("long").alias("h"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("ver"), F.lit(0).cast("long").alias("place"))
    got = {(r.h, r.doc): r.first_doc for r in _sorted_runs.repeated(rows, ["h"], 2, "test").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.h, []).append(r.doc)
    assert got == {(h, d): min(ds) for h, ds in by.items() if len(ds) > 1 for d in ds}


def test_every_passage_stays_in_its_first_document(spark):
    rng = random.Random(11)
    parts = {name: prose(70, 500 + i) for i, name in enumerate("ABCDE")}
    docs = []
    for i in range(25):
        names = rng.sample(sorted(parts), rng.randint(1, 3))
        docs.append((i, names, " ".join(parts[n] for n in names)))
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(df).collect()}
    seen = set()
    for i, names, text in docs:
        for n in names:
            # A chunk at a passage's border may be another one in each document.
            if n not in seen:
                assert parts[n][60:-60] in cut[i]
            else:
                assert parts[n][100:-100] not in cut[i]
        seen |= set(names)
