"""The beam with a row per hypothesis: widths of thousands, level by level.

The fold of `decode.beam` keeps all hypotheses of a game in one row; here a ply is a
step over rows (game, state, moves, shares, logp):

1. every live hypothesis becomes its `per_ply` best moves, scored without playing
   them; whether a move ends the game is told by the few pits that decide it;
2. the `width` best of a game stay, by likelihood, then by the rank of the parent,
   then of the move: an order that can be taken piecewise, so each part of a game is
   cut to `width` where its children were made before the parts meet;
3. only what stays is played.  Boards of all children are made at plies with a diagram
   alone, whose evidence counts before the cut.

Finished hypotheses are never cut; where no child is live, the parents stay as the
last ones.  States are written to the shared folder every `levels` plies, which cuts
the plan, and a lost executor costs part of these plies.  Results equal the fold's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.functions.rules import let
from plyframe.sources.shared import shared_folder

from . import decode

#: How a row ends a level: it goes on, was finished by its last move, or was among the
#: last live ones when the game's plies or moves ran out.
OPEN, FINISHED, LAST = 0, 1, 2



def _children(per_ply: int, shown: bool) -> Column:
    """What a row (with its ply's q) becomes: itself, and its children where it is open.
    Without a diagram in any game's ply (`shown`) no evidence is asked for."""
    told = rules.outcome("state", "c.action")
    seen = let("mv", rules.play("state", "c.action"), decode.evidence("mv.state", "q.check"))
    seen = f" + if(q.check is null, 0D, {seen})" if shown else ""
    child = let(
        "o",
        told,
        f"named_struct('kind', if(o.over, {FINISHED}, {OPEN}), 'child', k, 'action', c.action, 'move', concat(o.notation, if(o.captured > 0, '+', '')), 'share', -c.neg / if(all_ = 0, 1D, all_), "
        f"'logp', logp + ln(greatest(-c.neg, {decode.SCORE_FLOOR})){seen})",
    )
    made = let("ranked_", decode.scored_moves("state", "q.p", "q.marg"), let("all_", "aggregate(ranked_, 0D, (s_, x_) -> s_ - x_.neg)", f"transform(slice(ranked_, 1, {per_ply}), (c, k) -> {child})"))
    own = f"array(named_struct('kind', if(kind = {OPEN}, {LAST}, kind), 'child', cast(null as int), 'action', cast(null as int), 'move', cast(null as string), 'share', cast(null as double), 'logp', logp))"
    return F.expr(f"if(kind = {OPEN} and q is not null, concat({own}, {made}), {own})")


def _level(rows: DataFrame, plies: DataFrame, ply: int, shown: bool, per_ply: int, parts: int, spread: int) -> DataFrame:
    """One ply for every game that has it."""
    rows = rows.withColumn("part", F.when(F.col("kind") == OPEN, F.col("rank") % spread).otherwise(0))
    by = ["game", "part"] if spread > 1 else ["game"]
    mine = plies.filter(F.col("ply") == ply).select("game", "q")
    met = rows.repartition(parts, *by).join(F.broadcast(mine) if spread > 1 else mine, "game", "left")
    grown = met.select("game", "part", "level", "rank", "width", "state", "moves", "shares", F.posexplode_outer(_children(per_ply, shown)).alias("_", "c")).select("game", "part", "level", "rank", "width", "state", "moves", "shares", "c.*")
    order = [F.desc("logp"), "rank", "child"]
    if spread > 1:
        best = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order))
        grown = grown.withColumn("nth", best).filter(f"kind <> {OPEN} or nth <= width").drop("nth")
    nth = F.row_number().over(Window.partitionBy("game", "kind").orderBy(*order))
    live = F.max(F.col("kind") == OPEN).over(Window.partitionBy("game"))
    kept = grown.withColumn("nth", nth).withColumn("live", live)
    # A parent goes where a child lives; rows that were settled before have no new kind.
    kept = kept.filter(f"(kind = {OPEN} and nth <= width) or (kind = {FINISHED}) or (kind = {LAST} and (not live or level < {ply}))")
    new = F.col("action").isNotNull()
    played = F.when(new, F.expr(let("mv", rules.play("state", "action"), "mv.state"))).otherwise(F.col("state"))
    # Among finished ones the earlier level comes first, then the parent, then the move.
    rank = F.when(F.col("kind") == OPEN, F.col("nth") - 1).when(new, F.col("rank") * (per_ply + 1) + F.col("child")).otherwise(F.col("rank"))
    return kept.select(
        "game",
        "kind",
        F.when(new, ply + 1).otherwise(F.col("level")).alias("level"),
        rank.cast("long").alias("rank"),
        "width",
        played.alias("state"),
        F.when(new, F.concat("moves", F.array("move"))).otherwise(F.col("moves")).alias("moves"),
        F.when(new, F.concat("shares", F.array("share"))).otherwise(F.col("shares")).alias("shares"),
        "logp",
    )


def wide_beam(dists: DataFrame, width: int = 1024, per_ply: int = 9, results: DataFrame | None = None, levels: int = 4) -> DataFrame:
    """The chosen hypothesis of each game: game, moves, shares, logp and state.

    dists: game, ply (from 0, without gaps), p (move classes) and check (20 diagram
    distributions after that ply, or null), and width where games have their own;
    results: game and result (0, 1, -1, null).  Widths are cut to what the pool's
    memory takes.
    """
    spark = dists.sparkSession
    asked = F.col("width") if "width" in dists.columns else F.lit(width)
    dists = dists.withColumn("width", decode.beam_cap(asked, F.lit(per_ply)))
    folder = f"{shared_folder(spark)}/beam-{uuid.uuid4().hex}"
    q = F.struct("p", F.expr(decode.marginals("p")).alias("marg"), F.col("check").cast(decode.CHECK).alias("check"))
    dists.select("game", "ply", "width", q.alias("q")).write.parquet(f"{folder}/plies")
    plies = spark.read.parquet(f"{folder}/plies")
    n_games, n_plies = plies.agg(F.count_distinct("game"), F.max("ply") + 1).first()
    shown = {r["ply"] for r in plies.filter("q.check is not null").select("ply").distinct().collect()}  # a game's plies at most
    cores = spark.sparkContext.defaultParallelism
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    # Few games are spread over the cores; many are a task's work each, and then all
    # that a level moves is its hypotheses, once.
    spread = max(1, min(64, 2 * cores // max(n_games, 1)))
    empty = "cast(array() as array<string>) as moves", "cast(array() as array<double>) as shares"
    rows = plies.groupBy("game").agg(F.max("width").alias("width")).selectExpr("game", f"{OPEN} as kind", "0 as level", "0L as rank", "width", f"{rules.START} as state", *empty, "0D as logp")
    for ply in range(n_plies or 0):
        rows = _level(rows, plies, ply, ply in shown, per_ply, parts, spread)
        if (ply + 1) % levels == 0 or ply + 1 == n_plies:
            rows.write.parquet(f"{folder}/level-{ply}")
            rows = spark.read.parquet(f"{folder}/level-{ply}")
            if rows.filter(f"kind = {OPEN}").isEmpty():
                break
    stated = rows.join(results.select("game", "result"), "game", "left") if results is not None else rows.withColumn("result", F.lit(None).cast("int"))
    # Longest first, then agreement with the result, then likelihood; live before finished.
    key = F.struct(F.size("moves"), F.expr(decode.result_consistency("state", "result")), "logp", (F.col("kind") != FINISHED).alias("live"), -F.col("level"), -F.col("rank"))
    best = stated.groupBy("game").agg(F.max_by(F.struct("moves", "shares", "logp", "state"), key).alias("h"))
    return best.select("game", "h.*")
