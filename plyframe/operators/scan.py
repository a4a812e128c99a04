"""Prefix scans: running sums, maxima and counts in which no key is one task's work.

Rows are range-partitioned by key and order and kept with the number of their
block (`block_rows`), at least as many blocks as asked.  A block's part of a key has
totals; for a key that covers several blocks the totals before each block are
summed up, at most one row a block; and a window over (key, block) begins with
those.  A key with a third of all rows is a third of the blocks.

Rows that are equal in all of the order come in any order: give a total one.
Null keys are one key; null orders come first; null values add nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyframe.sources.shared import shared_folder

BLOCK = "_block"
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def block_rows(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """The rows with their block's number, as a written table: blocks are ranges of
    (keys, order), so that a second reader finds the same ones."""
    spark = rows.sparkSession
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    rows.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], running: Mapping[str, tuple[str, str]], totals: Mapping[str, tuple[str, str]] | None = None, blocks: int | None = None) -> DataFrame:
    """Add to each row the columns `running`: {name: (sum|max|min|count, column)} over the
    key's rows up to and with it, and `totals` over all of the key's rows."""
    totals = totals or {}
    cut = block_rows(rows, keys, order, blocks)
    of = lambda how, c: F.col(c).isNotNull().cast("long") if how == "count" else F.col(c)
    merge = {n: _MERGE["sum" if how == "count" else how] for n, (how, _) in {**running, **totals}.items()}
    cut = cut.withColumns({f"_v_{n}": of(how, c) for n, (how, c) in running.items()} | {f"_t_{n}": of(how, c) for n, (how, c) in totals.items()})
    parts = cut.groupBy(*keys, BLOCK).agg(*[merge[n](f"_v_{n}").alias(f"_v_{n}") for n in running], *[merge[n](f"_t_{n}").alias(f"_t_{n}") for n in totals])
    over = Window.partitionBy(*keys)
    before = over.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # What comes before a block goes into its windows as a row ahead of its rows.
    ahead = parts.select(*keys, BLOCK, F.lit(0).alias("_row"), *[merge[n](f"_v_{n}").over(before).alias(f"_v_{n}") for n in running], *[merge[n](f"_t_{n}").over(over).alias(f"_t_{n}") for n in totals])
    both = cut.drop(*[f"_t_{n}" for n in totals]).withColumn("_row", F.lit(1)).unionByName(ahead, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, BLOCK).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [merge[n](f"_v_{n}").over(inside).alias(n) for n in running] + [F.first(f"_t_{n}").over(inside).alias(n) for n in totals]
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], "_row", *columns).filter("_row = 1").drop("_row")


def running_mean(rows: DataFrame, value: str, weight: str, keys: list[str], order: list[str], name: str = "mean") -> DataFrame:
    """Weighted mean of a key's rows so far."""
    product = rows.withColumn("_vw", F.col(value) * F.col(weight))
    done = prefix_scan(product, keys, order, {"_s": ("sum", "_vw"), "_w": ("sum", weight)})
    return done.withColumn(name, F.col("_s") / F.col("_w")).drop("_vw", "_s", "_w")


def best_so_far(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str = "best") -> DataFrame:
    """Whether a row is at least as good as all before it; later ties replace."""
    return prefix_scan(rows, keys, order, {"_top": ("max", value)}).withColumn(name, F.col(value) >= F.col("_top")).drop("_top")


def quantiles(rows: DataFrame, value: str, keys: list[str], shares: Mapping[str, float], upper: bool = False) -> DataFrame:
    """Exact quantiles of each key's values, a column for each share: interpolated
    between the two nearest (or the upper one with `upper`).

    Equal values are counted first; the running count of a key's distinct values tells
    which of them hold the wanted ranks.  No key's values are gathered: the largest
    thing a task has is a block of distinct (key, value).  Nulls do not count; a key
    without values has nulls.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = prefix_scan(counts, keys, ["_v"], {"_upto": ("sum", "_n")}, {"_all": ("sum", "_n")})
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    asked, columns = [], []
    for i, (name, share) in enumerate(shares.items()):
        at = (F.col("_all") - 1) * F.lit(float(share))
        low = F.floor(at) if not upper else F.floor(F.col("_all") * F.lit(float(share)))
        asked += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l{i}"), F.max(F.when(holds(low + 1), F.col("_v"))).alias(f"_h{i}"), F.max(at - low).alias(f"_f{i}")]
        a, b, f = F.col(f"_l{i}"), F.coalesce(f"_h{i}", f"_l{i}"), F.col(f"_f{i}")
        columns.append((a if upper else F.when(f == 0, a).otherwise(a + (b - a) * f)).alias(name))
    found = placed.groupBy(*keys).agg(*asked).select(*keys, *columns)
    if upper or not keys:
        return found
    every = rows.select(*[F.col(k).alias(f"_e_{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_e_{i}").eqNullSafe(F.col(k))
    return every.join(found, same, "left").select(*[F.col(f"_e_{i}").alias(k) for i, k in enumerate(keys)], *shares)
