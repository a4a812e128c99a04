"""Queries of metrics, windows and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.operators import metrics, pages, scan
from plyframe.sources import samples

from . import adapters


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against the order of the first ten dimensions."""
    rows = adapters.logits64(spark, sf_dir).select("vec_id", "label", F.expr("slice(z, 1, 10)").alias("z"))
    return rows.select("vec_id", "label", F.expr("transform(slice(array_sort(transform(z, (v, i) -> named_struct('n', -v, 'i', i))), 1, 3), x -> x.i)").alias("top3"))


_SCORED = "z AS (SELECT vec_id, label, unnest(range(10)) AS i, unnest(embedding[1:10])::DOUBLE AS z FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) AS rn FROM z)"


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: share of right first choices, by label; NULL where there is nothing."""
    s = _scored(spark, sf_dir)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("top3")[0] == F.col("label")).cast("int")), 6).alias("accuracy"))


def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: top-1 and top-3 hits over all rows."""
    s = _scored(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.sum((F.col("top3")[0] == F.col("label")).cast("long")).alias("top1"), F.sum(F.array_contains("top3", F.col("label")).cast("long")).alias("top3"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per row: OK, ~3 or MISS."""
    mark = F.when(F.col("top3")[0] == F.col("label"), "OK").when(F.array_contains("top3", F.col("label")), "~3").otherwise("MISS")
    return _scored(spark, sf_dir).select("vec_id", F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("top3", lambda x: x.cast("string")), "/"), mark).alias("line"))


_EPOCH = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount (in percent) so far, weighted by quantity, per supplier.
    Sums are of whole numbers, so that their order does not matter."""
    t = adapters.table(spark, sf_dir, "lineitem").select(*_EPOCH, "l_suppkey", F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.col("l_quantity").cast("long").alias("q"))
    return scan.running_mean(t, "d", "q", ["l_suppkey"], _EPOCH).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("mean", 6).alias("mean"))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that replace the best, later ties included."""
    t = adapters.table(spark, sf_dir, "lineitem").select(*_EPOCH, "l_suppkey")
    return scan.best_so_far(t, "l_extendedprice", ["l_suppkey"], _EPOCH).filter("best").select("l_suppkey", "l_orderkey", "l_extendedprice")


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of quantities per supplier."""
    return scan.quantiles(adapters.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"], {"upper_median": 0.5}, upper=True)


def median_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged median."""
    return scan.quantiles(adapters.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_suppkey"], {"median": 0.5}).withColumn("median", F.round("median", 4))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated 50th and 99.5th percentile."""
    p = scan.quantiles(adapters.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_suppkey"], {"p50": 0.5, "p995": 0.995})
    return p.select("l_suppkey", F.round("p50", 2).alias("p50"), F.round("p995", 2).alias("p995"))


def band_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line through the points of a band."""
    t = adapters.table(spark, sf_dir, "lineitem")
    return t.groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


def page_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the column edges, both bands averaged, and the cell height."""
    t = adapters.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 4).alias("col"), "l_quantity", "l_extendedprice")
    by_col = t.groupBy("l_suppkey", "col").agg(F.avg("l_quantity").alias("x0"), F.min("l_extendedprice").alias("top"), F.max("l_extendedprice").alias("bottom"))
    return by_col.select("l_suppkey", "col", F.round("x0", 4).alias("x0"), F.round(F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy("l_suppkey")) / 11, 4).alias("cell_height"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's grid for each supplier: where its eight tables are, a little askew; some
    pages are too small for all of their boxes."""
    key, tilt = F.col("s_suppkey"), (F.col("s_nationkey") - 12) / 1000.0
    x0 = F.array(*[c * 300.0 + key % 17 for c in range(4)])
    lines = lambda down: F.array(*[F.struct(tilt.alias("slope"), (down + band * 700.0 + key % 11).alias("offset")) for band in range(2)])
    grid = F.struct(x0.alias("x0"), F.transform(x0, lambda x: x + 240 + key % 5).alias("x1"), lines(60.0).alias("top"), lines(390.0).alias("bottom"), (28.0 + key % 7 * 0.5).alias("cell"))
    page = F.struct((1500 - key % 4 * 150).cast("int").alias("height"), (1300 - key % 3 * 100).cast("int").alias("width"))
    # The file is small and the boxes are many: pages are dealt to all cores first.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return adapters.table(spark, sf_dir, "supplier").repartition(parts, "s_suppkey").select("s_suppkey", grid.alias("grid"), page.alias("page"))


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 160 move cells of each page, cut to the page."""
    rows = _grids(spark, sf_dir).select("s_suppkey", F.posexplode_outer(pages.clamped(pages.move_boxes(F.col("grid")), F.col("page"))).alias("_", "b"))
    return rows.select("s_suppkey", "b.move_no", "b.side", "b.x", "b.y", "b.w", "b.h")


def layout_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 pits and 2 kazans of each page's 8 diagrams, cut to the page."""
    rows = _grids(spark, sf_dir).select("s_suppkey", F.posexplode_outer(pages.clamped(pages.diagram_boxes(F.col("grid")), F.col("page"))).alias("_", "b"))
    return rows.select("s_suppkey", "b.kind", "b.move_no", "b.side", "b.pit_index", "b.x", "b.y", "b.w", "b.h")


def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 8 x 8 images at boxes that may reach over the edge: size and sum."""
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(F.transform("im", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("pixels"))
    key = F.col("vec_id")
    box = F.struct(F.lit("move").alias("kind"), F.lit(1).alias("move_no"), F.lit("W").alias("side"), F.lit(0).alias("pit_index"), (key % 9 - 2.5).alias("x0"), (key % 7 - 1.0).alias("y0"), (key % 9 + key % 4 + 0.5).alias("x1"), (key % 7 + 3.0).alias("y1"))
    rows = _images(spark, sf_dir).select("vec_id", image.alias("image")).withColumn("boxes", pages.clamped(F.array(box), F.col("image")))
    cut = rows.select("vec_id", F.col("boxes")[0].alias("b"), pages.crops(F.col("image"), F.col("boxes"))[0].alias("c"))
    total = F.aggregate(F.sequence(F.lit(1), F.length("c.pixels")), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substring("c.pixels", i, F.lit(1))), 16, 10).cast("long"))
    return cut.select("vec_id", F.col("b.w").alias("w"), F.col("b.h").alias("h"), F.when((F.col("b.w") > 0) & (F.col("b.h") > 0), total).otherwise(0).alias("total"))


_BOXES = "b AS (SELECT l_orderkey AS page, l_quantity AS x, l_extendedprice AS y, l_quantity * l_extendedprice AS area, l_partkey, l_linenumber FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("area"), "l_partkey", "l_linenumber")


def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a page's points: smallest and largest x+y and y-x."""
    b = _boxes(spark, sf_dir)
    return b.groupBy("page").agg(F.min(F.round(F.col("x") + F.col("y"), 2)).alias("tl"), F.max(F.round(F.col("x") + F.col("y"), 2)).alias("br"), F.min(F.round(F.col("y") - F.col("x"), 2)).alias("tr"), F.max(F.round(F.col("y") - F.col("x"), 2)).alias("bl"))


def skew_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: median edge angle in degrees, clipped to 15; none under 0.05."""
    b = _boxes(spark, sf_dir).select("page", F.degrees(F.atan2(F.col("x") - 25, F.col("y") / 100)).alias("a"))
    m = scan.quantiles(b, "a", ["page"], {"m": 0.5}).select("page", F.least(F.lit(15.0), F.greatest(F.lit(-15.0), "m")).alias("m"))
    return m.select("page", F.round(F.when(F.abs("m") < 0.05, F.lit(0.0)).otherwise(F.col("m")), 4).alias("angle"))


def area_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes near the median area of their page, if at least eight remain; else
    all.  The eight largest of them stay.  A supplier's boxes are a page; medians and
    counts are a row a page, and the eight are taken before and after the shuffle."""
    t = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("area"), "l_orderkey", "l_partkey", "l_linenumber")
    near = t.join(scan.quantiles(t, "area", ["page"], {"m": 0.5}), "page").withColumn("near", (F.col("area") > 0.5 * F.col("m")) & (F.col("area") < 2 * F.col("m")))
    counts = near.groupBy("page").agg(F.sum(F.col("near").cast("int")).alias("n"))
    kept = near.join(counts, "page").filter("near or n < 8")
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("area"), "l_orderkey", "l_partkey", "l_linenumber"))
    return kept.withColumn("rank", rank).filter("rank <= 8").select("page", F.col("rank").cast("long").alias("rank"), F.round("area", 2).alias("area"), F.col("n").alias("near"))


def band_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest boxes, then the upper and lower four from left to right."""
    big = _boxes(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("area"), "l_partkey", "l_linenumber"))).filter("r <= 8")
    band = big.withColumn("band", F.floor((F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "r")) - 1) / 4))
    return band.select("page", "band", (F.row_number().over(Window.partitionBy("page", "band").orderBy("x", "y", "r")) - 1).alias("place"), "l_partkey")


def game_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6: cells in the order of the game: by move, white first."""
    e = adapters.table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id div 7 % 40").alias("move_no"), F.when(F.col("event_id") % 2 == 0, "W").otherwise("B").alias("side"))
    w = Window.partitionBy("user_id").orderBy("move_no", F.col("side") != "W", "event_id")
    return e.select("user_id", "event_id", F.row_number().over(w).alias("ply"))


def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a user before the first one of little value."""
    e = adapters.table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    stop = F.min(F.when(F.col("value") < 2, F.col("n"))).over(Window.partitionBy("user_id"))
    return e.withColumn("stop", stop).filter("stop is null or n < stop").groupBy("user_id").agg(F.count("*").alias("kept"))


def ink_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with enough ink for their kind."""
    t = adapters.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "kazan").when(F.col("l_linenumber") == 2, "pit").otherwise("move").alias("kind"), (F.col("l_discount") / 2).alias("ink"))
    return t.filter(metrics.has_ink(F.col("kind"), F.col("ink"))).groupBy("kind").agg(F.count("*").alias("n"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray images of 8 x 8."""
    return adapters.logits64(spark, sf_dir).select("vec_id", "label", F.expr("transform(z, x -> int(greatest(0, least(255, floor(128 + 400 * x)))))").alias("im"))


_IMG = "im AS (SELECT vec_id, label, unnest(range(64)) AS i, greatest(0, least(255, floor(128 + 400 * unnest(embedding)::DOUBLE)))::BIGINT AS v FROM embeddings)"


def ink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dark pixels off the margins."""
    return _images(spark, sf_dir).select("vec_id", F.round(F.expr(metrics.ink_ratio("im", 8, 8, 110)), 6).alias("ink"))


def border_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background colour of an image from its edges."""
    return _images(spark, sf_dir).select("vec_id", F.expr(metrics.border_median("im")).alias("median"))


def tight_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of the bright part."""
    return _images(spark, sf_dir).select("vec_id", F.expr(metrics.tight_bbox("im", 190)).alias("b")).select("vec_id", "b.*")


def tta_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seven horizontal shifts of an image leave: +d cuts d columns from the
    left, -d from the right; the sum of the rest."""
    views = _images(spark, sf_dir).select("vec_id", "im", F.explode(F.expr("sequence(-3, 3)")).alias("shift"))
    left = "filter(im, (v, i) -> if(shift >= 0, i % 8 >= shift, i % 8 < 8 + shift))"
    return views.select("vec_id", "shift", F.expr(f"aggregate({left}, 0L, (s, v) -> s + v)").alias("total"))


def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 samples of each class."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return adapters.logits64(spark, sf_dir).select("vec_id", "label", F.row_number().over(w).alias("n")).filter("n <= 20")


def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per digit and source, `procedural only` where there is none."""
    have = adapters.table(spark, sf_dir, "part").filter("p_size % 10 <> 4").groupBy((F.col("p_size") % 10).cast("long").alias("digit")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").alias("digit")).join(have, "digit", "left").select("digit", F.coalesce(F.col("n").cast("string"), F.lit("procedural only")).alias("pool"))


def synth_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each vector, its class drawn by seed and number from the
    brands of the parts, against the vector's label."""
    vectors = adapters.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    brands = [r["p_brand"] for r in adapters.table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]  # a list of classes
    drawn = samples.samples(spark, vectors.count(), 1234, brands)
    return drawn.join(vectors, drawn["sample"] == vectors["vec_id"]).select("sample", F.col("class_idx").cast("long").alias("class_idx"), "class", "label")


QUERIES = {f.__name__: f for f in (accuracy, topk_accuracy, eval_report, running_mean, best_so_far, upper_median, median_exact, percentiles, band_fit, page_grid, layout_cells, layout_diagram, crop_pixels, corner_order, skew_angle, area_outlier, band_split, game_order, take_while, ink_filter, ink_ratio, border_median, tight_bbox, tta_views, cap_per_key, pool_counts, synth_draw)}

_ORDER = ", ".join(_EPOCH)
#: DuckDB: a row per table of each page's grid, and a box cut to its page.
_GRID = """WITH g AS (SELECT s_suppkey AS k, t, (s_nationkey - 12)::DOUBLE / 1000.0::DOUBLE AS tilt, (t % 4 * 300 + s_suppkey % 17)::DOUBLE AS x0, (240 + s_suppkey % 5)::DOUBLE AS bw, x0 + bw / 2 AS xc,
    (60 + t // 4 * 700 + s_suppkey % 11)::DOUBLE AS up, (390 + t // 4 * 700 + s_suppkey % 11)::DOUBLE AS down, 28 + (s_suppkey % 7)::DOUBLE * 0.5::DOUBLE AS cell, 1300 - s_suppkey % 3 * 100 AS pw, 1500 - s_suppkey % 4 * 150 AS ph FROM supplier, range(8) r(t))"""
_CUT = "trunc(greatest(0, ax))::BIGINT AS x, trunc(greatest(0, ay))::BIGINT AS y, greatest(0, trunc(least(pw, bx))::BIGINT - trunc(greatest(0, ax))::BIGINT) AS w, greatest(0, trunc(least(ph, ey))::BIGINT - trunc(greatest(0, ay))::BIGINT) AS h"
ORACLE = {
    "accuracy": f"WITH {_SCORED} SELECT label, count(*) AS n, round(avg((i = label)::INT), 6) AS accuracy FROM r WHERE rn = 1 GROUP BY label",
    "topk_accuracy": f"WITH {_SCORED} SELECT count(DISTINCT vec_id) AS n, sum((i = label AND rn = 1)::BIGINT)::BIGINT AS top1, sum((i = label)::BIGINT)::BIGINT AS top3 FROM r WHERE rn <= 3",
    "eval_report": f"WITH {_SCORED} SELECT vec_id, vec_id || ' ' || string_agg(i::VARCHAR, '/' ORDER BY rn) || ' ' || CASE WHEN max(CASE WHEN rn = 1 THEN i END) = any_value(label) THEN 'OK' WHEN bool_or(i = label) THEN '~3' ELSE 'MISS' END AS line FROM r WHERE rn <= 3 GROUP BY vec_id",
    "running_mean": f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round((sum(round(l_discount * 100)::BIGINT * l_quantity::BIGINT) OVER w)::DOUBLE / (sum(l_quantity::BIGINT) OVER w)::DOUBLE, 6) AS mean FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)",
    "best_so_far": f"SELECT l_suppkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY l_extendedprice >= max(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey",
    "median_exact": "SELECT l_suppkey, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_suppkey",
    "percentiles": "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 2) AS p50, round(quantile_cont(l_extendedprice, 0.995), 2) AS p995 FROM lineitem GROUP BY l_suppkey",
    "band_fit": "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_suppkey",
    "page_grid": "WITH c AS (SELECT l_suppkey, l_linenumber % 4 AS col, avg(l_quantity) AS x0, min(l_extendedprice) AS t, max(l_extendedprice) AS b FROM lineitem GROUP BY ALL) SELECT l_suppkey, col, round(x0, 4) AS x0, round(avg(b - t) OVER (PARTITION BY l_suppkey) / 11, 4) AS cell_height FROM c",
    "layout_cells": _GRID + """, e AS (SELECT *, CASE WHEN s = 0 THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS l, CASE WHEN s = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS r FROM g, range(10) a(i), range(2) b(s)),
        q AS (SELECT k, (t * 10 + i + 1)::BIGINT AS move_no, CASE WHEN s = 0 THEN 'W' ELSE 'B' END AS side, x0 + l * bw AS ax, x0 + r * bw AS bx, (tilt * xc + up) + (i + 1) * cell AS ay, (tilt * xc + up) + (i + 1) * cell + cell AS ey, pw, ph FROM e)
        SELECT k AS s_suppkey, move_no, side, """ + _CUT + " FROM q",
    "layout_diagram": _GRID + """, d AS (SELECT *, (t + 1) * 10 AS move_no, x0 + -0.1::DOUBLE * bw AS gx, 1.05::DOUBLE * bw / 9 AS pw9, (tilt * xc + down) + 2.49::DOUBLE * cell AS top, cell * 1.1::DOUBLE AS high FROM g),
        q AS (SELECT k, 'pit' AS kind, move_no, CASE WHEN o = 0 THEN 'B' ELSE 'W' END AS side, CASE WHEN o = 0 THEN 9 - j ELSE j + 1 END AS pit_index, gx + j * pw9 AS ax, gx + (j + 1) * pw9 AS bx,
              CASE WHEN o = 0 THEN top ELSE top + high END AS ay, CASE WHEN o = 0 THEN top ELSE top + high END + high AS ey, pw, ph FROM d, range(2) a(o), range(9) b(j)
              UNION ALL SELECT k, 'kazan', move_no, CASE WHEN o = 0 THEN 'B' ELSE 'W' END, 0, gx + 4 * pw9, gx + 4 * pw9 + 2 * pw9, CASE WHEN o = 0 THEN top - high ELSE top + 2 * high END, CASE WHEN o = 0 THEN top - high ELSE top + 2 * high END + high, pw, ph FROM d, range(2) a(o))
        SELECT k AS s_suppkey, kind, move_no, side, pit_index, """ + _CUT + " FROM q",
    "crop_pixels": f"""WITH {_IMG}, b AS (SELECT vec_id, greatest(0, trunc(vec_id % 9 - 2.5::DOUBLE))::BIGINT AS x, greatest(0, vec_id % 7 - 1) AS y, least(8, trunc(vec_id % 9 + vec_id % 4 + 0.5::DOUBLE))::BIGINT AS x1, least(8, vec_id % 7 + 3) AS y1 FROM embeddings)
        SELECT b.vec_id, greatest(0, any_value(x1 - x)) AS w, greatest(0, any_value(y1 - y)) AS h, coalesce(sum(v) FILTER (WHERE i % 8 >= x AND i % 8 < x1 AND i // 8 >= y AND i // 8 < y1), 0)::BIGINT AS total FROM b JOIN im ON im.vec_id = b.vec_id GROUP BY b.vec_id""",
    "corner_order": f"WITH {_BOXES} SELECT page, min(round(x + y, 2)) AS tl, max(round(x + y, 2)) AS br, min(round(y - x, 2)) AS tr, max(round(y - x, 2)) AS bl FROM b GROUP BY page",
    "skew_angle": f"WITH {_BOXES}, m AS (SELECT page, least(15.0, greatest(-15.0, median(degrees(atan2(x - 25, y / 100))))) AS m FROM b GROUP BY page) SELECT page, round(CASE WHEN abs(m) < 0.05 THEN 0 ELSE m END, 4)::DOUBLE AS angle FROM m",
    "area_outlier": "WITH b AS (SELECT l_suppkey AS page, l_quantity * l_extendedprice AS area, l_orderkey, l_partkey, l_linenumber FROM lineitem), m AS (SELECT *, median(area) OVER (PARTITION BY page) AS m FROM b), n AS (SELECT *, area > 0.5::DOUBLE * m AND area < 2 * m AS near FROM m), k AS (SELECT *, sum(near::INT) OVER (PARTITION BY page) AS n FROM n) SELECT page, row_number() OVER (PARTITION BY page ORDER BY area DESC, l_orderkey, l_partkey, l_linenumber) AS rank, round(area, 2) AS area, n::BIGINT AS near FROM k WHERE near OR n < 8 QUALIFY rank <= 8",
    "band_split": f"WITH {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, l_partkey, l_linenumber) AS r FROM b), t AS (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY y, x, r) - 1) // 4 AS band FROM r WHERE r <= 8) SELECT page, band, row_number() OVER (PARTITION BY page, band ORDER BY x, y, r) - 1 AS place, l_partkey FROM t",
    "game_order": "WITH e AS (SELECT user_id, event_id, event_id // 7 % 40 AS m, event_id % 2 <> 0 AS b FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY m, b, event_id) AS ply FROM e",
    "take_while": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT *, min(CASE WHEN value < 2 THEN n END) OVER (PARTITION BY user_id) AS stop FROM e) SELECT user_id, count(*) AS kept FROM s WHERE stop IS NULL OR n < stop GROUP BY user_id",
    "ink_filter": "WITH c AS (SELECT CASE l_linenumber WHEN 1 THEN 'kazan' WHEN 2 THEN 'pit' ELSE 'move' END AS kind, l_discount / 2 AS ink FROM lineitem) SELECT kind, count(*) AS n FROM c WHERE ink >= CASE WHEN kind = 'kazan' THEN 0.028::DOUBLE ELSE 0.02::DOUBLE END GROUP BY kind",
    "ink_ratio": f"WITH {_IMG} SELECT vec_id, round(sum((v < 110 AND i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 0 AND 6)::INT) / 64.0::DOUBLE, 6) AS ink FROM im GROUP BY vec_id",
    "border_median": f"WITH {_IMG}, e AS (SELECT vec_id, v FROM im WHERE i // 8 IN (0, 7) UNION ALL SELECT vec_id, v FROM im WHERE i % 8 IN (0, 7)) SELECT vec_id, floor(median(v))::BIGINT AS median FROM e GROUP BY vec_id",
    "tight_bbox": f"WITH {_IMG}, o AS (SELECT vec_id, min(i % 8) AS x0, min(i // 8) AS y0, max(i % 8) + 1 AS x1, max(i // 8) + 1 AS y1 FROM im WHERE v > 190 GROUP BY vec_id) SELECT e.vec_id, x0, y0, x1, y1 FROM embeddings e LEFT JOIN o ON o.vec_id = e.vec_id",
    "tta_views": f"WITH {_IMG} SELECT vec_id, s - 3 AS shift, coalesce(sum(v) FILTER (WHERE CASE WHEN s - 3 >= 0 THEN i % 8 >= s - 3 ELSE i % 8 < 8 + s - 3 END), 0)::BIGINT AS total FROM im, range(7) r(s) GROUP BY ALL",
    "cap_per_key": "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings QUALIFY n <= 20",
    "pool_counts": "SELECT digit, coalesce(n::VARCHAR, 'procedural only') AS pool FROM range(10) r(digit) LEFT JOIN (SELECT p_size % 10 AS d, count(*) AS n FROM part WHERE p_size % 10 <> 4 GROUP BY 1) ON d = digit",
    "synth_draw": """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part))
        SELECT vec_id AS sample, k AS class_idx, p_brand AS class, label FROM embeddings JOIN b ON k = ('0x' || substr(md5('1234:' || vec_id::VARCHAR), 1, 8))::BIGINT % n""",
}
