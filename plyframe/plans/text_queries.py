"""Queries over round metadata, names and small sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.functions import rules, text
from plyframe.operators import decode, gate

from . import adapters
from .prob_queries import _NAMES, class_domain

#: Spellings dealt to the lines by o_orderkey % 11; the last is unknown.
SPELLINGS = ["", "*", "1", "1-0", "0", "0-1", "5", "0.5-0.5", "1/2-1/2", "draw", "2-2"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game lines `White,Black,Result,WhiteTime,BlackTime`; every third white name
    has a quoted comma, every 13th line a field too many."""
    o, c = adapters.table(spark, sf_dir, "orders"), adapters.table(spark, sf_dir, "customer")
    white = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit(', jr"'))).otherwise(F.col("c_name"))
    spelt = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("o_orderkey") % 11 + 1).cast("int"))
    clock = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1:"), (F.col("o_orderkey") % 60).cast("string"))).otherwise(F.lit(""))
    extra = F.when(F.col("o_orderkey") % 13 == 0, F.lit(",x")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", white, F.concat(F.lit(" "), "o_orderpriority"), spelt, clock, F.lit("")), extra)
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", line.alias("line"))


_LINES = (
    "sp AS (SELECT * FROM (VALUES (0, ''), (1, '*'), (2, '1'), (3, '1-0'), (4, '0'), (5, '0-1'), (6, '5'), (7, '0.5-0.5'), (8, '1/2-1/2'), (9, 'draw'), (10, '2-2')) v(k, spelt)), "
    "ln AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name || ', jr' ELSE c_name END AS white, o_orderpriority AS black, spelt, "
    "CASE WHEN o_orderkey % 2 = 0 THEN '1:' || (o_orderkey % 60)::VARCHAR ELSE '' END AS clock, o_orderkey % 13 = 0 AS extra FROM orders JOIN customer ON o_custkey = c_custkey JOIN sp ON k = o_orderkey % 11), "
    "rc AS (SELECT * FROM (VALUES ('1', 0), ('1-0', 0), ('0', 1), ('0-1', 1), ('5', -1), ('0.5-0.5', -1), ('1/2-1/2', -1), ('draw', -1)) v(s, code))"
)

#: DuckDB: requests, their game lines and metadata from the fields that their text is made of.
_GATE = """gl AS (SELECT *, o_custkey || '-' || o_orderkey % 3 AS request, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS n FROM ln LEFT JOIN rc ON s = spelt),
rq AS (SELECT request, o_custkey AS k, count(*) AS n_lines, count(*) + o_custkey % 4 - 1 AS n_images FROM gl GROUP BY request, o_custkey),
rd AS (SELECT request, k, CASE WHEN k % 5 = 0 THEN '' WHEN k % 11 = 3 THEN 'x7' WHEN k % 7 = 0 THEN '' ELSE '0' || k % 25 END AS t FROM rq),
me AS (SELECT *, CASE WHEN k % 5 > 0 AND k % 13 = 0 THEN 'meta_fields' WHEN t = 'x7' THEN 'round_not_number' WHEN t <> '' AND t::BIGINT NOT BETWEEN 1 AND 20 THEN 'round_range' END AS error FROM rd),
mt AS (SELECT request, c_mktsegment AS event, c_name || ', "hall"' AS site, CASE WHEN k % 5 = 0 THEN '' ELSE 'd' || k END AS date, CASE WHEN t = '' THEN '' ELSE try_cast(t AS BIGINT)::VARCHAR END AS round, error,
       CASE error WHEN 'meta_fields' THEN '5' WHEN 'round_not_number' THEN t WHEN 'round_range' THEN (t::BIGINT)::VARCHAR END AS got FROM me JOIN customer ON c_custkey = k)"""
_FIRST = """bad AS (SELECT request, n, CASE WHEN extra THEN 'game_fields' ELSE 'game_result' END AS code, CASE WHEN extra THEN '6' ELSE spelt END AS got FROM gl WHERE extra OR (spelt NOT IN ('', '*') AND code IS NULL)),
fb AS (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY request ORDER BY n) = 1),
er AS (SELECT q.request, q.n_images, CASE WHEN n_images < 1 THEN 'no_images' WHEN n_images > 5 THEN 'too_many_images' WHEN mt.error IS NOT NULL THEN mt.error WHEN n_lines > n_images THEN 'game_lines' ELSE fb.code END AS code,
       CASE WHEN n_images BETWEEN 1 AND 5 AND mt.error IS NULL AND n_lines <= n_images THEN fb.n END AS line,
       CASE WHEN n_images < 1 OR n_images > 5 THEN n_images::VARCHAR WHEN mt.error IS NOT NULL THEN mt.got WHEN n_lines > n_images THEN n_lines::VARCHAR ELSE fb.got END AS got FROM rq q JOIN mt ON mt.request = q.request LEFT JOIN fb ON fb.request = q.request)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per customer and remainder of the order's key: its orders are game
    lines with blank lines between, its images one fewer to two more than lines."""
    lines = _lines(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 3)
    games = lines.groupBy("o_custkey", "part").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("g"))
    rows = games.join(adapters.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey")
    rounds = F.when(key % 11 == 3, "x7").when(key % 7 == 0, "").otherwise(F.concat(F.lit(" 0"), (key % 25).cast("string")))
    meta = F.concat(F.col("c_mktsegment"), F.lit(',"'), F.col("c_name"), F.lit(', ""hall"""'), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(",d"), key.cast("string"), F.lit(","), rounds)), F.when((key % 5 > 0) & (key % 13 == 0), ",more").otherwise(""))
    images = F.transform(F.sequence(F.lit(0), F.size("g") + (key % 4).cast("int") - 1), lambda i: i)
    return rows.select(F.concat_ws("-", "o_custkey", "part").alias("request"), meta.alias("meta_text"), F.array_join("g.line", "\n \n").alias("games_text"), F.lit("1024").alias("beam_choice"), F.filter(images, lambda i: i > 0).alias("images"))


def csv_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata lines parsed from text, with the error of a bad one."""
    m = _requests(spark, sf_dir).select("request", gate.parsed_meta(F.col("meta_text")).alias("m")).select("request", "m.*")
    return m.select("request", "event", "site", "date", "round", F.col("error.code").alias("error"), F.col("error.got").alias("got"))


def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each request that is not begun."""
    return gate.refused(_requests(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


def gate_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the other requests with names, results and tags."""
    return gate.admitted(_requests(spark, sf_dir)).select("request", F.col("n").cast("long").alias("n"), "name", F.col("result").cast("long").alias("result"), "tags")


def result_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spellings to codes; misspelt ones are marked, and so are capitals."""
    f = _lines(spark, sf_dir).select("o_orderkey", gate.padded(text.csv_fields(F.col("line")), gate.GAME)["result"].alias("spelt"))
    spelt = F.when(F.col("o_orderkey") % 7 == 0, F.upper("spelt")).otherwise(F.col("spelt"))
    return f.select("o_orderkey", spelt.alias("spelt")).select("o_orderkey", "spelt", text.result_code(F.col("spelt")).alias("code"), text.result_is_valid(F.col("spelt")).alias("valid"))


def pgn_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the nine tags; clocks only where given.  Every second line has no black
    clock's field at all."""
    f = _lines(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 4 < 2, F.regexp_replace("line", ",(,x)?$", "")).otherwise(F.concat("line", F.lit("2:5"))).alias("line"))
    game = gate.parsed_games(F.col("line"))[0]
    meta = gate.parsed_meta(F.concat(F.lit("Open,,d"), F.col("o_orderkey").cast("string")))
    return f.select("o_orderkey", text.pgn_tags(meta, game).alias("tags"))


def game_pad_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images joined with game lines by position per batch (a customer's lines in
    order; two images more than lines); missing lines are blank."""
    lines = _lines(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    images = lines.groupBy("o_custkey").agg(F.max("n").alias("m")).select("o_custkey", F.explode(F.expr("sequence(1, m + 2)")).alias("n"))
    return images.join(lines.select("o_custkey", "n", gate.padded(text.csv_fields(F.col("line")), gate.GAME)["white"].alias("white")), ["o_custkey", "n"], "left").select("o_custkey", "n", F.coalesce("white", F.lit("")).alias("white"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from free text."""
    return adapters.table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat(F.lit(" - "), "p_name", F.lit(" - / "), "p_type", F.lit("! \t"))).alias("slug"))


def label_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digit from a parent folder or from the stem, if there is one."""
    key, digit = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 10).cast("string")
    ways = [("/g/", digit, "/im_3 ", key), ("/g/set/", digit, "_", key), ("/g/12/", digit, "-4_", key), ("/g/set/", F.col("p_brand"), "_", digit), ("/g/a/", digit, " 7-", key), ("/g/0b/", digit, "", F.lit(""))]
    paths = F.array(*[F.concat(F.lit(a), b, F.lit(c), d, F.lit(".png")) for a, b, c, d in ways])
    return adapters.table(spark, sf_dir, "part").select("p_partkey", F.get(paths, (F.col("p_partkey") % 6).cast("int")).alias("path")).select("p_partkey", "path", text.label_from_path(F.col("path")).alias("label"))


def label_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows whose label is a class."""
    rows = adapters.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).cast("string").alias("class"))
    return rows.join(F.broadcast(class_domain(spark, sf_dir)), "class", "left_semi")


def unknown_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked moves that are no class."""
    asked = adapters.table(spark, sf_dir, "events").select((F.col("event_id") % 130).cast("string").alias("class")).distinct()
    return asked.join(class_domain(spark, sf_dir), "class", "left_anti")


def missing_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits 1-9 without an image, per brand."""
    have = adapters.table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 10).cast("long").alias("digit")).distinct()
    need = have.select("p_brand").distinct().crossJoin(F.broadcast(spark.range(1, 10).select(F.col("id").alias("digit"))))
    return need.join(have, ["p_brand", "digit"], "left_anti")


def warnings_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct warnings of a user in order of first occurrence."""
    seen = adapters.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return seen.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("w")).select("user_id", F.array_join("w.event_type", ",").alias("warnings"))


def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bad item gives an error row, the batch goes on."""
    n = F.try_divide(F.lit(1000), F.col("event_id") % 7)
    return adapters.table(spark, sf_dir, "events").select("event_id", F.when(n.isNull(), "division by zero").alias("error"), F.floor(n).alias("value"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: one line per game for display."""
    games = adapters.finals(spark, sf_dir).select("user_id", "n_plies", F.expr(rules.is_over("state")).alias("over"))
    why = decode.stop_reason(F.col("n_plies"), F.col("over"), F.when(F.col("user_id") % 4 == 1, F.lit(12)), F.when(F.col("user_id") % 3 == 1, F.lit(20)))
    return games.select("user_id", F.format_string("game%d: %d plies, %s", F.col("user_id"), F.col("n_plies"), why).alias("row"))


QUERIES = {f.__name__: f for f in (csv_meta, gate_errors, gate_admitted, result_codes, pgn_tags, game_pad_join, slug, label_from_path, label_semi, unknown_moves, missing_digits, warnings_distinct, batch_errors, result_rows)}


def _oracle() -> dict[str, str]:
    from .game_queries import GAMES_SQL

    return {
        "csv_meta": f"WITH {_LINES}, {_GATE} SELECT request, event, site, date, round, error, got FROM mt",
        "gate_errors": f"WITH {_LINES}, {_GATE}, {_FIRST} SELECT request, code, line, got FROM er WHERE code IS NOT NULL",
        "gate_admitted": f"""WITH {_LINES}, {_GATE}, {_FIRST}, im AS (SELECT e.*, unnest(range(1, n_images + 1)) AS n FROM er e WHERE code IS NULL)
            SELECT im.request, im.n, CASE WHEN mt.round <> '' THEN 'round' || mt.round || '_' ELSE '' END || 'game' || im.n AS name, g.code AS result, '[Event "' || mt.event || '"]' || chr(10) || '[Site "' || mt.site || '"]' || chr(10)
            || '[Date "' || CASE WHEN mt.date = '' THEN '?' ELSE mt.date END || '"]' || chr(10) || '[Round "' || CASE WHEN mt.round = '' THEN '?' ELSE mt.round END || '"]' || chr(10) || '[White "' || coalesce(g.white, '?') || '"]' || chr(10)
            || '[Black "' || coalesce(g.black, '?') || '"]' || chr(10) || '[Result "' || CASE g.code WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' WHEN -1 THEN '1/2-1/2' ELSE '*' END || '"]' || chr(10)
            || CASE WHEN g.clock <> '' THEN '[WhiteClock "' || g.clock || '"]' || chr(10) ELSE '' END || chr(10) AS tags FROM im JOIN mt ON mt.request = im.request LEFT JOIN gl g ON g.request = im.request AND g.n = im.n""",
        "result_codes": f"WITH {_LINES}, c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN upper(spelt) ELSE spelt END AS spelt FROM ln) SELECT o_orderkey, spelt, code, spelt IN ('', '*') OR code IS NOT NULL AS valid FROM c LEFT JOIN rc ON s = spelt",
        "pgn_tags": f"""WITH {_LINES} SELECT o_orderkey, '[Event "Open"]' || chr(10) || '[Site "?"]' || chr(10) || '[Date "d' || o_orderkey || '"]' || chr(10) || '[Round "?"]' || chr(10) || '[White "' || white || '"]' || chr(10) || '[Black "' || black || '"]' || chr(10)
            || '[Result "' || CASE code WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' WHEN -1 THEN '1/2-1/2' ELSE '*' END || '"]' || chr(10) || CASE WHEN clock <> '' THEN '[WhiteClock "' || clock || '"]' || chr(10) ELSE '' END
            || CASE WHEN o_orderkey % 4 >= 2 AND NOT extra THEN '[BlackClock "2:5"]' || chr(10) ELSE '' END || chr(10) AS tags FROM ln LEFT JOIN rc ON s = spelt""",
        "game_pad_join": f"WITH {_LINES}, nn AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM ln), im AS (SELECT o_custkey, unnest(range(1, max(n) + 3)) AS n FROM nn GROUP BY o_custkey) "
        "SELECT o_custkey, n, coalesce(white, '') AS white FROM im LEFT JOIN nn USING (o_custkey, n)",
        "slug": "SELECT p_partkey, trim(regexp_replace('- ' || p_name || ' - / ' || p_type || '!', '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS slug FROM part",
        "label_from_path": """WITH p AS (SELECT p_partkey, (p_partkey % 10)::VARCHAR AS d, CASE p_partkey % 6 WHEN 0 THEN '/g/' || p_partkey % 10 || '/im_3 ' || p_partkey WHEN 1 THEN '/g/set/' || p_partkey % 10 || '_' || p_partkey
            WHEN 2 THEN '/g/12/' || p_partkey % 10 || '-4_' || p_partkey WHEN 3 THEN '/g/set/' || p_brand || '_' || p_partkey % 10 WHEN 4 THEN '/g/a/' || p_partkey % 10 || ' 7-' || p_partkey ELSE '/g/0b/' || p_partkey % 10 END || '.png' AS path FROM part),
            q AS (SELECT *, string_split(path, '/') AS parts FROM p), r AS (SELECT *, parts[len(parts) - 1] AS parent, regexp_replace(parts[len(parts)], '[.]png$', '') AS stem FROM q),
            t AS (SELECT *, split_part(stem, '_', 1) AS a, split_part(stem, '-', 1) AS b, split_part(stem, ' ', 1) AS c FROM r)
            SELECT p_partkey, path, CASE WHEN length(parent) = 1 AND parent BETWEEN '0' AND '9' THEN parent WHEN length(a) = 1 AND a BETWEEN '0' AND '9' THEN a WHEN length(b) = 1 AND b BETWEEN '0' AND '9' THEN b WHEN length(c) = 1 AND c BETWEEN '0' AND '9' THEN c END AS label FROM t""",
        "label_semi": f"WITH {_NAMES} SELECT (event_id % 200)::VARCHAR AS class, event_id FROM events WHERE (event_id % 200)::VARCHAR IN (SELECT class FROM dim)",
        "unknown_moves": f"WITH {_NAMES} SELECT DISTINCT (event_id % 130)::VARCHAR AS class FROM events WHERE (event_id % 130)::VARCHAR NOT IN (SELECT class FROM dim)",
        "missing_digits": "SELECT p_brand, digit FROM (SELECT DISTINCT p_brand FROM part), range(1, 10) r(digit) EXCEPT SELECT p_brand, p_size % 10 FROM part",
        "warnings_distinct": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS k FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS warnings FROM f GROUP BY user_id",
        "batch_errors": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'division by zero' END AS error, CASE WHEN event_id % 7 <> 0 THEN floor(1000.0 / (event_id % 7))::BIGINT END AS value FROM events",
        "result_rows": GAMES_SQL + "SELECT user_id, 'game' || user_id || ': ' || ply || ' plies, ' || CASE WHEN user_id % 3 = 1 AND ply >= 20 THEN 'empty cell' WHEN user_id % 4 = 1 AND ply >= 12 THEN 'illegal move' WHEN over THEN 'game over' ELSE 'sheet exhausted' END AS row FROM won",
    }


ORACLE = _oracle()
