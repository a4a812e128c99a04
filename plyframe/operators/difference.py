"""The difference of two tables: a row for each field that differs.

Both tables' rows are counted by their keys and fields together, which leaves the rows
that are not in both, nulls being equal to nulls; only these meet by key.  A key that
one side lacks, or that has several differing rows on a side, is one row that says so,
so that repeated keys never make pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: `field` of rows about a whole key: left and right are then numbers of differing rows.
ROWS = "*"


def difference(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """The keys, field, left and right (as text) of what differs in `fields` (all other
    columns of left); nothing where the tables are equal."""
    fields = fields or [c for c in left.columns if c not in keys]

    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(*keys, F.struct(*fields).alias("_row"), F.lit(a).alias("_l"), F.lit(b).alias("_r"))

    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    odd = both.groupBy(*keys, "_row").agg((F.sum("_l") - F.sum("_r")).alias("_n")).filter("_n <> 0")
    more = lambda sign: F.sum(F.greatest(F.lit(0), F.col("_n") * sign))
    own = lambda sign: F.max(F.when(F.col("_n") * sign > 0, F.col("_row")))
    met = odd.groupBy(*keys).agg(more(1).alias("_l"), more(-1).alias("_r"), own(1).alias("_a"), own(-1).alias("_b"))
    told = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.cast("string").alias("left"), b.cast("string").alias("right"))
    one = (F.col("_l") == 1) & (F.col("_r") == 1)
    changed = F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), told(f, F.col("_a")[f], F.col("_b")[f])) for f in fields])
    rows = F.when(one, F.array_compact(changed)).otherwise(F.array(told(ROWS, F.col("_l"), F.col("_r"))))
    return met.select(*keys, F.explode_outer(rows).alias("_d")).select(*keys, "_d.*")
