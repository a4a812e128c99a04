"""Glyph pools: masks of single characters cut from photos, and which glyph a cell gets.

A request is a row (cell_id, kind, class): kind `move` with a notation or `empty`,
or kind `diagram` with a number, `x`, `-` or `empty`.  Its characters choose glyphs
from a pool by draws that are hashes of the cell's id, so a rerun or a lost task
chooses the same.  The choice is an equi-join on (character, source, rank).

Masks of ink are gray images, 255 where the pen was.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.functions.text import label_from_path
from plyframe.operators.images import IMAGE, _row, _struct_udf, _taps

FIELDS = IMAGE.removeprefix("struct<").removesuffix(">")
EMPTY, TUZDYK = "empty", "x"
#: Shares of glyphs from the first source and of crosses without a glyph.
ARDIS_SHARE, DRAWN_CROSS = 0.55, 0.35


def uniform(seed: int, *parts) -> Column:
    """A number from 0 to before 1 that depends on the seed and the parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 32)) / float(1 << 32)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _taps(image.shape[0], height) @ image @ _taps(image.shape[1], width).T


def photo_mask(image: Column) -> Column:
    """Mask of the ink on a photo, cut tight; nulls for tiny, blank and nearly blank ones."""

    def mask(pixels: np.ndarray) -> dict | None:
        if pixels.shape[0] < 10 or pixels.shape[1] < 5:
            return None
        dark = 255.0 - pixels
        signal = np.clip(dark - np.percentile(dark, 50), 0, None)
        peak = np.percentile(signal, 99.5)
        if peak < 12:
            return None
        found = np.clip(signal / peak, 0, 1)
        found[found < 0.18] = 0
        if (found > 0.18).sum() < 20:
            return None
        ys, xs = np.nonzero(found)
        found = found[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        return _row((found * 255).astype(np.uint8)) if found.shape[0] >= 8 and found.shape[1] >= 3 else None

    return _struct_udf(mask, FIELDS)(image)


def glyph_pool(photos: DataFrame, source: str) -> DataFrame:
    """Photos (path, image) as glyphs: (path, source, char, mask), mask or char null where
    the photo has to be skipped."""
    return photos.select("path", F.lit(source).alias("source"), label_from_path(F.col("path")).alias("char"), photo_mask(F.col("image")).alias("mask"))


def pool_counts(pool: DataFrame) -> DataFrame:
    """Glyphs by character, and the skipped ones under a null character."""
    good = F.col("char").isNotNull() & F.col("mask.pixels").isNotNull()
    return pool.groupBy(F.when(good, F.col("char")).alias("char")).agg(F.count("*").alias("glyphs"))


def chosen_glyphs(requests: DataFrame, pool: DataFrame, seed: int = 0) -> DataFrame:
    """A row a character of each request: (cell_id, kind, class, place, char, source, mask).

    Both sources present, the first is taken with probability .55; within a source any
    glyph is as likely.  A cross is drawn (null mask) with .35 or where none is in the
    pool, a dash always.  Place -1 is the digit of a diagram's neighbour, in 3 of 10.
    """
    good = pool.filter("char IS NOT NULL AND mask.pixels IS NOT NULL")
    ranked = good.select("char", "source", "mask", (F.row_number().over(Window.partitionBy("char", "source").orderBy("path")) - 1).alias("rank"))
    sizes = good.groupBy("char").pivot("source", ["ardis", "emnist"]).count()
    text = F.when(F.col("kind") != "diagram", F.col("class")).when(F.col("class").rlike("^[0-9]+$"), F.col("class").cast("int").cast("string")).otherwise(F.col("class"))
    own = F.when(F.col("class") == EMPTY, F.array().cast("array<string>")).otherwise(F.split(text, ""))
    own = F.transform(own, lambda c, i: F.struct(i.alias("place"), c.alias("char")))
    digit = F.floor(uniform(seed, F.col("cell_id"), F.lit("digit")) * 10).cast("int").cast("string")
    beside = F.when((F.col("kind") == "diagram") & (uniform(seed, F.col("cell_id"), F.lit("beside")) < 0.3), F.array(F.struct(F.lit(-1).alias("place"), digit.alias("char"))))
    none = F.array().cast("array<struct<place:int,char:string>>")
    rows = requests.select("cell_id", "kind", "class", F.explode_outer(F.concat(F.coalesce(own, none), F.coalesce(beside, none))).alias("c")).select("cell_id", "kind", "class", "c.place", "c.char")
    rows = rows.join(sizes, "char", "left")

    def draw(name: str) -> Column:
        return uniform(seed, F.col("cell_id"), F.col("place"), F.lit(name))

    drawn = (F.col("char") == TUZDYK) & (draw("cross") < DRAWN_CROSS)
    first = F.when(F.col("ardis").isNotNull() & (F.col("emnist").isNull() | (draw("source") < ARDIS_SHARE)), "ardis").when(F.col("emnist").isNotNull(), "emnist")
    rows = rows.withColumn("source", F.when(~F.coalesce(drawn, F.lit(False)), first))
    count = F.when(F.col("source") == "ardis", F.col("ardis")).otherwise(F.col("emnist"))
    rows = rows.withColumn("rank", F.floor(draw("rank") * count).cast("int")).drop("ardis", "emnist")
    return rows.join(ranked, ["char", "source", "rank"], "left").select("cell_id", "kind", "class", "place", "char", "source", "mask")


def fitted(image: Column, height: int, width: int, threshold: int = 128, fill: float = 0.8) -> Column:
    """The dark part of a cell, scaled to `fill` of a white canvas and put in its middle."""

    def fit(pixels: np.ndarray) -> dict:
        out = np.full((height, width), 255, np.uint8)
        ys, xs = np.nonzero(pixels < threshold)
        if len(ys):
            part = pixels[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
            scale = min(height * fill / part.shape[0], width * fill / part.shape[1])
            small = resized(part, max(1, int(part.shape[0] * scale)), max(1, int(part.shape[1] * scale)))
            top, left = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
            out[top : top + small.shape[0], left : left + small.shape[1]] = np.clip(np.rint(small), 0, 255)
        return _row(out)

    return _struct_udf(fit, FIELDS)(image)
