"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / weight, u a hash of its id and the seed, so
that documents in key order are a weighted sample without replacement.  A
source whose target is k whole epochs and a rest gives every document k times;
the rest is filled in key order, and the document at the border gives the words
that are still wanted.  Only built-in functions; no key is sorted in one task:
sizes are summed by (source, slice of the key's distribution), and only the
slice in which a source's rest ends is put in order.

Null text has no words; null sources are one source, sorted last.  Null ids are
drawn as the id "".  Rows equal in id and size share what the border leaves to
them evenly.  An empty table gives an empty result.
A very long text counts with all its words and, at a source's border, with part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WHITE, text_or_empty, written

#: Slices of a source's key distribution.
SLICES = 4096
#: Parts in which the rows of a source meet what is known of their source.
SALTS = 64
#: Characters that lower a document's quality weight.
NOISE = "0123456789#$%&*|!@<>{}[]="


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text: Column) -> Column:
    """The share of a text's characters that is no noise, at least 0.05."""
    n = F.char_length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.char_length(F.translate(text, NOISE, "")) / n))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: str) -> list[Column]:
    text = text_or_empty(text_col)
    w = weight if weight is not None else quality(text)
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), named).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return [
        F.col(source_col).isNull().alias("s_null"),
        F.coalesce(F.col(source_col), F.lit("")).alias("s"),
        F.col(id_col).cast("long").alias("id"),
        n_words(text).alias("size"),
        w.alias("w"),
        (-F.log(u) / w).alias("key"),
    ]


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """Add `target` to one row per source (s_null, s, source_size): sources by
    code point weigh `weights` in turn and share all words; no target exceeds
    most_epochs times its source, and the excess is shared by weight again."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("s_null", "s")) - 1).withColumn(
        "share", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    line = Window.orderBy(F.col("cap") / F.col("share"), "rank")
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    onward = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked.withColumn("cap", F.col("source_size") * most_epochs)
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("share").over(onward))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("share"))
        .withColumn("top", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("top") * F.col("share")))
        .drop("rank", "cap", "level", "capped", "top", "share")
    )


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows joined with the one row of their source; each source's row is there once
    per salt, so that a source of a third of all rows goes to many tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "id", "size"), F.lit(SALTS)).cast("int"))
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["s_null", "s", "salt"]).drop("salt")


def decisions(keyed: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """One row per source: target, epochs and the border (key, id, size, words)."""
    by = ["s_null", "s"]
    sources = targets(keyed.groupBy(*by).agg(F.sum("size").alias("source_size"), F.avg("w").alias("mean_w")), weights, most_epochs)
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = written(sources.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix-sources")
    sliced = with_source(keyed, sources.select(*by, "mean_w")).withColumn("slice", F.floor((1 - F.exp(-F.col("key") * F.col("mean_w"))) * SLICES)).drop("mean_w")
    sums = sliced.groupBy(*by, "slice").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = (
        sums.withColumn("before", before)
        .join(sources.select(*by, "rest"), by)
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(*by, "slice", "before", "rest")
    )
    order = [F.asc_nulls_last("key"), F.asc_nulls_last("id"), F.asc("size")]
    ahead = F.coalesce(F.sum("group_words").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    cut = (
        sliced.join(border, [*by, "slice"])
        .groupBy(*by, "key", "id", "size", "before", "rest")
        .agg(F.count("*").alias("copies"))
        .withColumn("group_words", F.col("size") * F.col("copies"))
        .withColumn("ahead", ahead)
        .filter((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("group_words")))
        .select(*by, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("ahead")) / F.col("copies")).alias("cut_words"))
    )
    return sources.join(cut, by, "left")


def _fraction() -> Column:
    """Words of the fractional epoch, for keyed rows joined with decisions()."""
    here = F.struct("key", F.col("id").isNull().alias("n"), F.col("id"), F.col("size"))
    cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_id").isNull().alias("n"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
    return F.when(F.col("cut_key").isNull() | (here > cut), F.lit(0)).when(here < cut, F.col("size")).otherwise(F.col("cut_words")).cast("long")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """One row per document: id, source, size, source_size, target, epochs, taken."""
    keyed = written(docs.select(*_keyed(docs, id_col, text_col, source_col, weight, seed)), "mix-keys")
    return with_source(keyed, decisions(keyed, weights, most_epochs)).select(
        "id",
        F.when(~F.col("s_null"), F.col("s")).alias("source"),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + _fraction()).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row for each epoch that takes
    a document; the border document's last row has the words taken of it.
    Documents without words are in no epoch's budget and stay once."""
    made = _keyed(docs, id_col, text_col, source_col, weight, seed)
    keyed = written(docs.select(*made), "mix-keys")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = with_source(docs.select(*made, row), decisions(keyed, weights, most_epochs)).withColumn("part", _fraction())
    whole = F.col("epochs") + F.when(F.col("size") == 0, 1).otherwise((F.col("part") == F.col("size")).cast("long"))
    short = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    words = F.array_join(F.slice(F.split(F.ltrim(F.col(f"row.{text_col}"), F.lit(WHITE)), r"[\x20\x09-\x0D]+"), 1, F.col("part").cast("int")), " ")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(whole + short.cast("long"))
    copies = joined.filter(times > 0).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    text = F.when(short & (F.col("nth") == times), words).otherwise(F.col(f"row.{text_col}"))
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
