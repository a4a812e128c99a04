"""Queries on the parts of a form: components, cells with labels, what a cell may say,
requests, file order and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.operators import reading
from plyframe.plans import adapters

#: Sides of the page that the components of component_size lie on.
PAGE_WIDTH, PAGE_HEIGHT = 300, 100_000


def component_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """components wider than a tenth of the page and higher than a tenth of it."""
    parts = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("h"))
    return parts.filter((F.col("w") * 10 > PAGE_WIDTH) & (F.col("h") * 10 > PAGE_HEIGHT))


def low_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the upper median of a page's cell heights is under 35 pixels."""
    cells = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").cast("int").alias("h"))
    counts = cells.groupBy("page", "h").agg(F.count("*").alias("n"))
    page = Window.partitionBy("page")
    upto = F.sum("n").over(page.orderBy("h"))
    at = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(page)).filter(F.col("upto") > F.floor(F.col("all") / 2))
    return at.groupBy("page").agg(F.min("h").alias("median")).select("page", "median", (F.col("median") < 35).alias("low_resolution"))


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 160 move cells of each of a nation's pages beside the label read there, or null."""
    keys = ["page", "move_no", "side"]
    seen = adapters.table(spark, sf_dir, "events").select(F.col("event_id"), (F.col("user_id") % 25).alias("page"), (F.col("event_id") % 80 + 1).alias("move_no"), F.when(F.col("event_id") % 3 == 0, "W").otherwise("B").alias("side"), "event_type")
    labels = seen.groupBy(*keys).agg(F.max_by("event_type", "event_id").alias("label"))
    cells = spark.range(25 * 160).select(F.floor(F.col("id") / 160).alias("page"), (F.floor(F.col("id") / 2) % 80 + 1).alias("move_no"), F.when(F.col("id") % 2 == 0, "W").otherwise("B").alias("side"))
    return cells.join(labels, keys, "left")


def allowed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cell of a diagram may say what was read: 10-81 in a kazan; 0-81, x
    or - in a pit."""
    values = F.transform(F.sequence(F.lit(0), F.lit(81)), lambda v: v.cast("string"))
    pit, kazan = F.array_union(values, F.array(F.lit("x"), F.lit("-"))), F.slice(values, 11, 72)
    number = F.col("event_id") % 90
    read = F.when(number == 89, "x").when(number == 88, "-").when(number == 87, "empty").otherwise(number.cast("string"))
    rows = adapters.table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "kazan").otherwise("pit").alias("kind"), read.alias("read"))
    return rows.withColumn("allowed", F.when(F.col("kind") == "kazan", F.array_contains(kazan, F.col("read"))).otherwise(F.array_contains(pit, F.col("read"))))


def same_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the sets of labels of a customer's even and odd orders: equal, and how many in
    only one of them.  Sets are joined as rows, so a customer of any size is no group."""
    rows = adapters.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("odd"), (F.col("o_orderkey") % 9 + 1).alias("label")).distinct()
    each = rows.groupBy("o_custkey", "label").agg(F.count("*").alias("sides"))
    return each.groupBy("o_custkey").agg(F.count_if(F.col("sides") == 1).alias("differing")).select("o_custkey", "differing", (F.col("differing") == 0).alias("equal"))


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each file among its folder's, names compared as text."""
    files = adapters.table(spark, sf_dir, "part").select("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("name")).cast("long"))


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a request with its orders as images: the error of one with
    more than five, and the beam's width from what was typed."""
    sizes = adapters.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("images"))
    typed = F.when(F.col("o_custkey") % 4 == 0, "many").when(F.col("o_custkey") % 4 == 1, F.concat(F.lit(" "), (F.col("o_custkey") % 7 * 512).cast("string"))).when(F.col("o_custkey") % 4 == 2, "").otherwise("4096")
    return sizes.select("o_custkey", "images", reading.request_error(F.col("images")).alias("error"), reading.beam_width(typed).cast("long").alias("width"))


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five rows to train, by a digest of the id, so that a rerun and a
    larger table leave every row where it was."""
    share = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    return adapters.table(spark, sf_dir, "labels").select("doc_id", F.when(share == 0, "test").otherwise("train").alias("part"))


QUERIES = {f.__name__: f for f in (component_size, low_resolution, cell_labels, allowed_reads, same_notations, file_order, request_checks, train_split)}

ORACLE = {
    "component_size": "SELECT l_orderkey, l_linenumber, l_quantity AS w, l_extendedprice AS h FROM lineitem WHERE l_quantity > 30 AND l_extendedprice > 10000",
    "low_resolution": """WITH c AS (SELECT l_suppkey AS page, CAST(floor(l_quantity) AS INT) AS h FROM lineitem), l AS (SELECT page, list_sort(list(h)) AS hs FROM c GROUP BY page)
        SELECT page, hs[len(hs) // 2 + 1] AS median, hs[len(hs) // 2 + 1] < 35 AS low_resolution FROM l""",
    "cell_labels": """WITH s AS (SELECT user_id % 25 AS page, event_id % 80 + 1 AS move_no, CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'B' END AS side, max_by(event_type, event_id) AS label FROM events GROUP BY ALL)
        SELECT p.page, m.move_no, d.side, s.label FROM range(25) p(page), range(1, 81) m(move_no), (VALUES ('W'), ('B')) d(side) LEFT JOIN s ON s.page = p.page AND s.move_no = m.move_no AND s.side = d.side""",
    "allowed_reads": """WITH r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'kazan' ELSE 'pit' END AS kind, CASE event_id % 90 WHEN 89 THEN 'x' WHEN 88 THEN '-' WHEN 87 THEN 'empty' ELSE CAST(event_id % 90 AS VARCHAR) END AS read FROM events)
        SELECT event_id, kind, read, CASE WHEN read IN ('x', '-') THEN kind = 'pit' WHEN read = 'empty' THEN false ELSE CAST(read AS INT) <= 81 AND (kind = 'pit' OR CAST(read AS INT) >= 10) END AS allowed FROM r""",
    "same_notations": """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 9 + 1) FILTER (WHERE o_orderkey % 2 = 0)) AS a, list_sort(list(DISTINCT o_orderkey % 9 + 1) FILTER (WHERE o_orderkey % 2 = 1)) AS b FROM orders GROUP BY o_custkey)
        SELECT o_custkey, len(coalesce(a, [])) + len(coalesce(b, [])) - 2 * len(list_intersect(coalesce(a, []), coalesce(b, []))) AS differing, coalesce(a = b, false) AS equal FROM s""",
    "file_order": "SELECT p_brand, p_partkey || '.png' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey || '.png') AS place FROM part",
    "request_checks": """SELECT o_custkey, count(*) AS images, CASE WHEN count(*) > 5 THEN 'at most 5 images, got ' || count(*) END AS error,
        CASE o_custkey % 4 WHEN 1 THEN greatest(1, o_custkey % 7 * 512) WHEN 3 THEN 4096 ELSE 2048 END AS width FROM orders GROUP BY o_custkey""",
    "train_split": "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM labels",
}
