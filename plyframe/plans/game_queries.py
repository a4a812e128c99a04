"""Queries of the rules engine, with an independent recursive SQL of the game."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.operators import decode, difference
from plyframe.sources.shared import shared_folder

from . import adapters

#: DuckDB: `plies` has a row per half-move, `finals` the last state of each game.
GAMES_SQL = """
WITH RECURSIVE ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (
  SELECT user_id, 0::BIGINT AS ply, list_transform(range(18), lambda i: 9::BIGINT) AS pits, 0::BIGINT AS k0, 0::BIGINT AS k1, -1::BIGINT AS t0, -1::BIGINT AS t1, 0::BIGINT AS turn,
         -1::BIGINT AS action, '' AS notation, 0::BIGINT AS captured, false AS made, list_transform(range(18), lambda i: 9::BIGINT) AS sown
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, ply + 1, list_transform(range(18), lambda i: CASE WHEN i = last AND gain > 0 THEN 0 ELSE held[i + 1] END),
         k0 + in0 + CASE WHEN turn = 0 THEN gain ELSE 0 END, k1 + in1 + CASE WHEN turn = 1 THEN gain ELSE 0 END,
         CASE WHEN made AND turn = 0 THEN last % 9 ELSE t0 END, CASE WHEN made AND turn = 1 THEN last % 9 ELSE t1 END, 1 - turn,
         a, (a + 1)::VARCHAR || (last % 9 + 1)::VARCHAR || CASE WHEN made THEN 'x' ELSE '' END, CASE WHEN made THEN 0 ELSE gain END, made, sown
  FROM (
    SELECT *, CASE WHEN made THEN 3 WHEN last // 9 = 1 - turn AND held[last + 1] % 2 = 0 THEN held[last + 1] ELSE 0 END AS gain FROM (
      SELECT *, last // 9 = 1 - turn AND held[last + 1] = 3 AND CASE WHEN turn = 0 THEN t0 ELSE t1 END = -1 AND last % 9 <> 8
                AND last % 9 <> CASE WHEN turn = 0 THEN t1 ELSE t0 END AS made FROM (
        SELECT *, CASE WHEN t0 < 0 THEN 0 ELSE sown[9 + t0 + 1] END AS in0, CASE WHEN t1 < 0 THEN 0 ELSE sown[t1 + 1] END AS in1,
               list_transform(range(18), lambda i: CASE WHEN (t0 >= 0 AND i = 9 + t0) OR (t1 >= 0 AND i = t1) THEN 0 ELSE sown[i + 1] END) AS held FROM (
          SELECT * EXCLUDE (sown), list_transform(range(18), lambda i: CASE WHEN n = 1 THEN CASE WHEN i = start THEN 0 WHEN i = last THEN pits[i + 1] + 1 ELSE pits[i + 1] END
                 ELSE CASE WHEN i = start THEN 0 ELSE pits[i + 1] END + (n + 17 - (i - start + 18) % 18) // 18 END) AS sown FROM (
            SELECT *, (start + greatest(1, n - 1)) % 18 AS last FROM (
              SELECT *, turn * 9 + a AS start, pits[turn * 9 + a + 1] AS n FROM (
                SELECT g.* EXCLUDE (made), can[event_id % len(can) + 1] AS a FROM (
                  SELECT *, list_filter(range(9), lambda a: pits[turn * 9 + a + 1] > 0 AND CASE WHEN turn = 0 THEN t1 ELSE t0 END <> a) AS can FROM g
                ) g JOIN ev ON ev.user_id = g.user_id AND ev.n = g.ply + 1 WHERE len(can) > 0 AND greatest(k0, k1) < 82)))))))
),
st AS (SELECT *, list_filter(range(9), lambda a: pits[turn * 9 + a + 1] > 0 AND CASE WHEN turn = 0 THEN t1 ELSE t0 END <> a) AS can, list_sum(pits[1:9])::BIGINT AS s0, list_sum(pits[10:18])::BIGINT AS s1 FROM g),
finals AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ply DESC) = 1),
plies AS (SELECT * FROM st WHERE ply > 0),
ends AS (SELECT *, greatest(k0, k1) >= 82 OR len(can) = 0 AS over,
         k0 + CASE WHEN greatest(k0, k1) < 82 AND len(can) = 0 AND turn = 1 THEN s0 ELSE 0 END AS f0,
         k1 + CASE WHEN greatest(k0, k1) < 82 AND len(can) = 0 AND turn = 0 THEN s1 ELSE 0 END AS f1 FROM finals),
won AS (SELECT *, CASE WHEN f0 > f1 THEN 0 WHEN f0 < f1 THEN 1 ELSE -1 END AS winner FROM ends),
texts AS (SELECT user_id, list(notation || CASE WHEN captured > 0 THEN '+' ELSE '' END ORDER BY ply) AS moves FROM plies GROUP BY user_id)
"""


def _joined(array: str) -> F.Column:
    return F.array_join(array, ",")


def _state_columns(state: str) -> list:
    s = F.col(state)
    return [_joined(s.pits).alias("pits"), s.kazans[0].alias("kazan0"), s.kazans[1].alias("kazan1"), s.tuz[0].alias("tuz0"), s.tuz[1].alias("tuz1")]


_STATE_SQL = "array_to_string(pits, ',') AS pits, k0 AS kazan0, k1 AS kazan1, t0 AS tuz0, t1 AS tuz1"


def playout_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole games as folds: moves played, final board, winner."""
    g = adapters.finals(spark, sf_dir)
    return g.select("user_id", "n_plies", *_state_columns("state"), F.expr(rules.winner("state")).alias("winner"), F.expr(rules.is_over("state")).alias("is_over"))


def sow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after sowing alone, for each half-move."""
    return adapters.plies(spark, sf_dir).select("user_id", "ply", _joined("sown").alias("sown"))


def legal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal notations before each half-move, in order."""
    shown = f"array_sort({rules.notations('before')})"
    return adapters.plies(spark, sf_dir).select("user_id", "ply", _joined(F.expr(shown)).alias("legal"))


def replay_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replayed move by move; move number user_id % 30 + 2 is spoilt, so
    replays stop there if the game is that long."""
    g = adapters.texts(spark, sf_dir)
    spoilt = F.transform("moves", lambda m, i: F.when(i == F.col("user_id") % 30 + 1, F.lit("00")).otherwise(m))
    r = g.select("user_id", spoilt.alias("moves")).select("user_id", F.expr(rules.replay("moves")).alias("r"))
    return r.select("user_id", F.size("r.played").alias("n_played"), F.col("r.stopped").alias("stopped"), F.array_join("r.played", " ").alias("played"), *_state_columns("r.state"))


def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wins at the end, and at move 40."""
    at_40 = F.expr("get(filter(plies, p -> p.ply = 40), 0).after")
    g = adapters.games(spark, sf_dir).select("user_id", "state", at_40.alias("mid"))
    return g.select("user_id", F.expr(rules.winner("state")).alias("winner"), F.expr(rules.is_over("state")).alias("is_over"), F.when(F.col("mid").isNotNull(), F.expr("mid.kazans[0] - mid.kazans[1]")).alias("lead_at_40"))


def side_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stones on each side and stones in all after each half-move."""
    return adapters.plies(spark, sf_dir).select("user_id", "ply", F.expr(rules.side_total("after", 0)).alias("side0"), F.expr(rules.side_total("after", 1)).alias("side1"), F.expr(f"{rules.side_total('after', 0)} + {rules.side_total('after', 1)} + after.kazans[0] + after.kazans[1]").alias("stones"))


def pgn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of two moves."""
    g = adapters.texts(spark, sf_dir)
    return g.select("user_id", F.expr(rules.pgn("moves")).alias("pgn"))


def raw_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a read move is among the legal ones; every fifth is misread."""
    p = adapters.plies(spark, sf_dir)
    raw = F.when(F.col("ply") % 5 == 0, F.concat(F.col("action") + 1, F.lit("0"))).otherwise(F.col("notation"))
    # A move's first character tells the only action that it can be, so one is written.
    return p.select("user_id", "ply", "before", raw.alias("raw")).select("user_id", "ply", "raw", F.expr(rules.fits("before", "raw")).alias("raw_is_legal"))


def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a sheet ends: an empty cell wins over anything before, an illegal move
    or the end of the game comes first, else the sheet is exhausted."""
    g = adapters.finals(spark, sf_dir).select("user_id", F.col("n_plies").alias("n"), F.expr(rules.is_over("state")).alias("over"))
    illegal_at = F.when(F.col("user_id") % 4 == 1, F.lit(12))
    empty_at = F.when(F.col("user_id") % 3 == 1, F.lit(20))
    return g.select("user_id", decode.stop_reason(F.col("n"), F.col("over"), illegal_at, empty_at).alias("stop_reason"))


def tuzdyk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-moves that make a tuzdyk or capture, and what each tuzdyk brought."""
    p = adapters.plies(spark, sf_dir)
    brought = lambda s: F.expr(f"if(before.tuz[{s}] < 0, 0, sown[{9 * (1 - s)} + before.tuz[{s}]])")
    return p.select("user_id", "ply", "makes_tuzdyk", "captured", brought(0).alias("income0"), brought(1).alias("income1"))


def result_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a stated result agrees with a position: 0, 1 or 2."""
    g = adapters.finals(spark, sf_dir)
    stated = F.expr("if(user_id % 4 = 3, null, int(user_id % 4) - 1)")
    return g.select("user_id", stated.alias("stated"), "state").select("user_id", "stated", F.expr(decode.result_consistency("state", "stated")).alias("consistency"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per half-move with the fields that a replay fixture has."""
    s = F.col("after")
    sides = [F.expr(rules.side_total("after", k)).alias(f"p{k + 1}_side") for k in (0, 1)]
    return adapters.plies(spark, sf_dir).select("user_id", "ply", F.col("notation").alias("move"), s.kazans[0].alias("p1_kazan"), s.kazans[1].alias("p2_kazan"), *sides, s.tuz[0].alias("p1_tuzdyk"), s.tuz[1].alias("p2_tuzdyk"))


def replay_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed half-moves against a copy in which some kazans are one too many,
    some moves are not told, some rows are missing and some are there twice."""
    # Games are folded once, not once for each side of the difference.
    folder = f"{shared_folder(spark)}/told-{uuid.uuid4().hex}"
    _told(spark, sf_dir).write.parquet(folder)
    told = spark.read.parquet(folder)
    at = lambda a, b, m: (F.col("user_id") * a + F.col("ply") * b) % m == 0
    spoilt = told.withColumns({"p1_kazan": F.col("p1_kazan") + at(7, 1, 50).cast("int"), "move": F.when(~at(3, 1, 70), F.col("move"))}).filter(~at(1, 1, 97))
    found = difference.difference(told, spoilt.unionByName(spoilt.filter(at(1, 5, 89))), ["user_id", "ply"])
    return found.select("user_id", "ply", "field", F.col("left").alias("told"), F.col("right").alias("copied"))


QUERIES = {f.__name__: f for f in (playout_fold, sow, legal_moves, replay_strict, winner, side_totals, pgn_format, raw_legality, stop_reason, tuzdyk_events, result_consistency, replay_difference)}

_LEGAL_SQL = """
moves AS (SELECT user_id, ply, pits, t0, t1, turn, a, pits[turn * 9 + a + 1] AS n, turn * 9 + a AS start FROM (SELECT *, unnest(can) AS a FROM st)),
lands AS (SELECT *, (start + greatest(1, n - 1)) % 18 AS last FROM moves),
drops AS (SELECT *, CASE WHEN (t0 >= 0 AND last = 9 + t0) OR (t1 >= 0 AND last = t1) THEN 0
          WHEN n = 1 THEN pits[last + 1] + 1 ELSE CASE WHEN last = start THEN 0 ELSE pits[last + 1] END + (n + 17 - (last - start + 18) % 18) // 18 END AS held FROM lands),
named AS (SELECT user_id, ply, (a + 1)::VARCHAR || (last % 9 + 1)::VARCHAR || CASE WHEN last // 9 = 1 - turn AND held = 3 AND CASE WHEN turn = 0 THEN t0 ELSE t1 END = -1
          AND last % 9 <> 8 AND last % 9 <> CASE WHEN turn = 0 THEN t1 ELSE t0 END THEN 'x' ELSE '' END AS notation FROM drops)
"""

ORACLE = {
    "playout_fold": GAMES_SQL + f"SELECT user_id, ply AS n_plies, {_STATE_SQL}, winner, over AS is_over FROM won",
    "sow": GAMES_SQL + "SELECT user_id, ply, array_to_string(sown, ',') AS sown FROM plies",
    "legal_moves": GAMES_SQL + "," + _LEGAL_SQL + "SELECT p.user_id, p.ply, string_agg(n.notation, ',' ORDER BY n.notation) AS legal FROM plies p JOIN named n ON n.user_id = p.user_id AND n.ply = p.ply - 1 GROUP BY p.user_id, p.ply",
    "replay_strict": GAMES_SQL
    + f""", cut AS (SELECT w.user_id, least(w.ply, w.user_id % 30 + 1) AS n FROM won w)
        SELECT c.user_id, c.n AS n_played, CASE WHEN w.ply >= w.user_id % 30 + 2 THEN '00' END AS stopped, array_to_string(t.moves[1:c.n], ' ') AS played, array_to_string(s.pits, ',') AS pits, s.k0 AS kazan0, s.k1 AS kazan1, s.t0 AS tuz0, s.t1 AS tuz1
        FROM cut c JOIN won w ON w.user_id = c.user_id JOIN texts t ON t.user_id = c.user_id JOIN st s ON s.user_id = c.user_id AND s.ply = c.n""",
    "winner": GAMES_SQL + "SELECT w.user_id, w.winner, w.over AS is_over, m.k0 - m.k1 AS lead_at_40 FROM won w LEFT JOIN st m ON m.user_id = w.user_id AND m.ply = 40",
    "side_totals": GAMES_SQL + "SELECT user_id, ply, s0 AS side0, s1 AS side1, s0 + s1 + k0 + k1 AS stones FROM plies",
    "pgn_format": GAMES_SQL
    + """, lines AS (SELECT user_id, (ply + 1) // 2 AS k, string_agg(notation || CASE WHEN captured > 0 THEN '+' ELSE '' END, ' ' ORDER BY ply) AS line FROM plies GROUP BY ALL)
        SELECT user_id, string_agg(k::VARCHAR || '. ' || line, chr(10) ORDER BY k) || chr(10) AS pgn FROM lines GROUP BY user_id""",
    "raw_legality": GAMES_SQL + "SELECT user_id, ply, CASE WHEN ply % 5 = 0 THEN (action + 1)::VARCHAR || '0' ELSE notation END AS raw, ply % 5 <> 0 AS raw_is_legal FROM plies",
    "stop_reason": GAMES_SQL + "SELECT user_id, CASE WHEN user_id % 3 = 1 AND ply >= 20 THEN 'empty cell' WHEN user_id % 4 = 1 AND ply >= 12 THEN 'illegal move' WHEN over THEN 'game over' ELSE 'sheet exhausted' END AS stop_reason FROM won",
    "tuzdyk_events": GAMES_SQL + """SELECT p.user_id, p.ply, p.made AS makes_tuzdyk, p.captured, CASE WHEN b.t0 < 0 THEN 0 ELSE p.sown[10 + b.t0] END AS income0, CASE WHEN b.t1 < 0 THEN 0 ELSE p.sown[1 + b.t1] END AS income1
        FROM plies p JOIN st b ON b.user_id = p.user_id AND b.ply = p.ply - 1""",
    "result_consistency": GAMES_SQL + """SELECT user_id, CASE WHEN user_id % 4 <> 3 THEN user_id % 4 - 1 END AS stated, CASE WHEN user_id % 4 = 3 THEN CASE WHEN over THEN 1 ELSE 0 END
        WHEN over AND winner = user_id % 4 - 1 THEN 2 WHEN CASE WHEN k0 > k1 THEN 0 WHEN k0 < k1 THEN 1 ELSE -1 END = user_id % 4 - 1 THEN 1 ELSE 0 END AS consistency FROM won""",
    "replay_difference": GAMES_SQL + """, c AS (SELECT *, CASE WHEN (user_id * 7 + ply) % 50 = 0 THEN 1 ELSE 0 END AS more, (user_id * 3 + ply) % 70 = 0 AS untold, (user_id + ply) % 97 = 0 AS gone, (user_id + 5 * ply) % 89 = 0 AS twice FROM plies)
        SELECT user_id, ply, '*' AS field, '1' AS told, '0' AS copied FROM c WHERE gone
        UNION ALL SELECT user_id, ply, '*', CASE WHEN more = 1 OR untold THEN '1' ELSE '0' END, CASE WHEN more = 1 OR untold THEN '2' ELSE '1' END FROM c WHERE NOT gone AND twice
        UNION ALL SELECT user_id, ply, 'p1_kazan', k0::VARCHAR, (k0 + 1)::VARCHAR FROM c WHERE NOT gone AND NOT twice AND more = 1
        UNION ALL SELECT user_id, ply, 'move', notation, NULL FROM c WHERE NOT gone AND NOT twice AND untold""",
}
