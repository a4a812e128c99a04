"""Both likenesses come back from the fingerprint strings alone."""

import random

import pytest
from pyspark.sql import functions as F

from plyframe.llm import iblt

from .test_operators import prose

ALL = (1 << 64) - 1


def parse(shown):
    bits, _, cells = shown.partition("|")
    table = {}
    for cell in filter(None, cells.split(",")):
        at, count, key, check = cell.split(":")
        table[int(at, 16)] = [int(count), int(key, 16), int(check, 16)]
    return int(bits), table


def places(digest, bits):
    return [(row << bits) | ((digest >> (21 * row)) & ((1 << bits) - 1)) for row in range(3)]


def peel(bits, table):
    """Signed digests of a table; a cell with one digest is where that digest belongs."""
    table, found = {k: list(v) for k, v in table.items()}, {}
    while True:
        pure = [(at, v) for at, v in table.items() if abs(v[0]) == 1 and at in places(v[1], bits)]
        if not pure:
            assert not any(v[0] or v[1] or v[2] for v in table.values())
            return found
        at, (sign, digest, check) = pure[0]
        found[digest] = sign
        for p in places(digest, bits):
            cell = table.setdefault(p, [0, 0, 0])
            cell[0] -= sign
            cell[1] ^= digest
            cell[2] ^= check
        table = {k: v for k, v in table.items() if v[0] or v[1] or v[2]}


def likeness(one, two):
    (wide, a), (other, b) = parse(one), parse(two)
    if wide == other:  # cells subtract as they are stored
        cells = {p: [x - y if i == 0 else x ^ y for i, (x, y) in enumerate(zip(a.get(p, [0] * 3), b.get(p, [0] * 3)))] for p in a.keys() | b.keys()}
        d = len(peel(wide, {p: v for p, v in cells.items() if any(v)}))
    else:
        d = len(peel(wide, a).keys() ^ peel(other, b).keys())
    n = sum(v[0] for v in a.values()) // 3 + sum(v[0] for v in b.values()) // 3
    return 1.0 if not n else 1 - d / n


def test_likeness_from_strings(spark):
    rng = random.Random(4)
    rows = [(i, ". ".join(prose(rng.randint(3, 25), 10 * i + k) for k in range(rng.choice([0, 1, 5, 40])))) for i in range(40)]
    rows += [(50, None), (51, "one"), (52, rows[7][1]), (53, prose(30_000, 99))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in iblt.fingerprints(df, digests=iblt.piece_digests).collect()}
    ids = sorted(got)
    for k, i in enumerate(ids):
        assert got[i].near_edited == pytest.approx(likeness(got[i].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_next == pytest.approx(likeness(got[i].fingerprint, got[ids[k - 1]].fingerprint))
    assert got[52].fingerprint == got[7].fingerprint
    want = df.select("doc_id", iblt.piece_digests("text").alias("d")).filter("text is not null").collect()
    for r in want:
        assert peel(*parse(got[r.doc_id].fingerprint)).keys() == {x & ALL for x in r.d}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c. d e f."), (1, "a b c. d e f."), (1, "other words. here"), (None, "no id"), (None, None)]
    got = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({repr(r) for r in got if r.n_chars == 13}) == 1


def test_a_narrow_table_fails_and_the_wider_one_gives_all(spark, monkeypatch):
    monkeypatch.setattr(iblt, "LOAD", 1)
    monkeypatch.setattr(iblt, "LEAST_BITS", 1)
    rows = [(i, ". ".join(prose(4, 100 * i + k) for k in range(30 + i))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = iblt.fingerprints(df, digests=iblt.piece_digests).select(F.max("near_next").alias("m"), F.min("near_edited").alias("e")).first()
    assert got.m == 0 and 0.4 < got.e < 0.8
