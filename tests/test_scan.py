"""Prefix scans and quantiles against plain Python, with a hot key."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.operators import scan


def made(n=4000, seed=3):
    """Rows (key, at, value, weight): one key has nearly all of them; nulls and ties."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 30 + ["a", "b", None])
    return [(key(), i, None if rng.random() < 0.05 else float(rng.randrange(200)), rng.randrange(1, 5)) for i in range(n)]


SCHEMA = "key string, at long, value double, weight long"


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_running_sums_maxima_counts_and_totals(spark, blocks):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = scan.prefix_scan(df, ["key"], ["at"], {"s": ("sum", "weight"), "top": ("max", "value"), "low": ("min", "value"), "n": ("count", "value")}, {"all": ("count", "value"), "most": ("max", "value")}, blocks)
    state, want = {}, {}
    for key, at, value, weight in sorted(rows, key=lambda r: r[1]):
        s, seen = state.get(key, (0, []))
        seen = [*seen, value] if value is not None else seen
        state[key] = s + weight, seen
        want[at] = (s + weight, max(seen, default=None), min(seen, default=None), len(seen))
    for r in got.collect():
        assert (r.s, r.top, r.low, r.n) == want[r["at"]]
        assert (r["all"], r.most) == (len(state[r.key][1]), max(state[r.key][1]))


def test_a_hot_key_is_no_single_task(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.lit(1).alias("one"))
    kept = scan.block_rows(df, ["key"], ["at"], 16)
    sizes = [r["count"] for r in kept.groupBy(scan.BLOCK).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    assert scan.prefix_scan(df, ["key"], ["at"], {"n": ("sum", "one")}, blocks=16).filter("n <> at + 1").count() == 0


def test_quantiles_are_numpys(spark):
    rows = made(900)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p995": 0.995, "p100": 1.0}
    got = {r.key: r for r in scan.quantiles(spark.createDataFrame(rows, SCHEMA), "value", ["key"], shares).collect()}
    for key in {r[0] for r in rows}:
        values = [v for k, _, v, _ in rows if k == key and v is not None]
        for name, q in shares.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), abs=1e-9)
        assert got[key].p50 == pytest.approx(median(values))


def test_upper_median_and_empty_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "key string, value double")
    assert {r.key: r.m for r in scan.quantiles(df, "value", ["key"], {"m": 0.5}, upper=True).collect()} == {"a": 3.0, "b": 5.0}
    assert {r.key: r.m for r in scan.quantiles(df, "value", ["key"], {"m": 0.5}).collect()} == {"a": 2.5, "b": 5.0, "c": None}
    assert scan.quantiles(df.limit(0), "value", ["key"], {"m": 0.5}).count() == 0


def test_no_unbounded_buffer_in_the_plan(spark):
    df = spark.createDataFrame(made(50), SCHEMA)
    plan = scan.quantiles(df, "value", ["key"], {"m": 0.5})._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_list" not in plan
