"""The plan keeps its configurations, and stays near the lower bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.llm import packing

BIG = "/root/testdata/sf0.1/documents.parquet"


def test_configurations_stay_and_the_bound_is_near(spark):
    pieces = packing.token_pieces(spark.read.parquet(BIG)).filter("length < 1024").groupBy("length").count().collect()
    histogram = np.zeros(1024, np.int64)
    for r in pieces:
        histogram[r["length"]] = r["count"]
    least = 257
    grouped = packing.linear_groups(histogram, least, 192)
    assert max(sum(n for _, n in g) for g in grouped) - min(sum(n for _, n in g) for g in grouped[:-1]) <= 0
    found = packing.configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], 1024)
    kept, _ = packing.substitute(grouped, [(p, int(x + 1e-7)) for p, x in found if x >= 1 - 1e-7])
    runs = packing.plan(histogram, 1024)
    # Every sequence of a configuration is there with its pieces; small ones may have joined it.
    large = {}
    for items, n in runs:
        key = tuple(sorted(x for x in items if x >= least))
        large[key] = large.get(key, 0) + n
    wanted = {}
    for items, n in kept:
        wanted[tuple(sorted(items))] = wanted.get(tuple(sorted(items)), 0) + n
    joined = sum(n for k, n in wanted.items() if large.get(k, 0) >= n)
    assert joined >= 0.95 * sum(wanted.values())
    bound = -(-int((histogram * np.arange(1024)).sum()) // 1024)
    assert sum(n for _, n in runs) <= 1.01 * bound


@pytest.mark.parametrize("rows_a_salt", [3, 1_000_000])
def test_salted_ranks_give_every_piece_a_place(spark, monkeypatch, rows_a_salt):
    monkeypatch.setattr(packing, "SALT_ROWS", rows_a_salt)
    df = spark.range(200).select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 1024).otherwise(F.col("id") % 7 + 1).cast("long").alias("length"), (F.col("id") * 17).alias("ids_crc32"))
    got = packing.pack(df).collect()
    assert len(got) == 200
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
