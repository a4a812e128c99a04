"""Games of any length: a fold in segments that carries the board along.

A player's events are numbered by a prefix scan and cut into segments of at most
`segment` events.  Round k folds segment k of every game that is not over from the
board that round k - 1 left, so that no row and no task ever has more of one game than
a segment, whatever share of all events a game has.  A game that is over takes no
further part: rounds end with the longest game, not with the longest list of events.

Where no game has more events than a segment (counted first), there is one round and
nothing to number: the events of a game are gathered by the one shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.operators import scan
from plyframe.sources.shared import shared_folder

#: Events of a game that are folded in one row.
SEGMENT = 256


def _gathered(rows: DataFrame, order: list[str], value: str, parts: int) -> DataFrame:
    """user_id and its values in order, by one shuffle of an explicit number of partitions:
    a fold is much work on few bytes, which adaptive execution would put in one task."""
    by_user = rows.repartition(parts, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value")))).alias("e"))
    return by_user.select("user_id", F.col("e._value").alias("choices"))


def fold_games(events: DataFrame, keep: str | None = "plies", order: tuple[str, ...] = ("ts", "event_id"), choice: str = "event_id", segment: int = SEGMENT, first: int | None = None) -> DataFrame:
    """user_id and game, as rules.playout gives it: the choices of a user's events in
    `order` (a total one) are played one after another; with `first`, so many of them."""
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    longest = events.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    if longest <= segment:
        taken = "choices" if first is None else f"slice(choices, 1, {first})"
        return _gathered(events, list(order), choice, parts).select("user_id", F.expr(rules.playout(taken, keep)).alias("game"))

    folder = f"{shared_folder(spark)}/games-{uuid.uuid4().hex}"
    numbered = scan.prefix_scan(events.select("user_id", *dict.fromkeys([*order, choice])), ["user_id"], list(order), {"n": ("count", "user_id")}, {"n_events": ("count", "user_id")})
    if first is not None:
        numbered = numbered.filter(F.col("n") <= first).withColumn("n_events", F.least("n_events", F.lit(first)))
    numbered.select("user_id", "n", F.col(choice).alias("choice"), "n_events", F.floor((F.col("n") - 1) / segment).alias("segment")).write.parquet(f"{folder}/events")
    numbered = spark.read.parquet(f"{folder}/events")
    live, ended, k = None, [], 0
    while True:
        mine = numbered.filter(F.col("segment") == k)
        counts = mine.groupBy("user_id").agg(F.max("n_events").alias("n_events"))
        gathered = _gathered(mine, ["n"], "choice", parts).join(counts, "user_id")
        if live is None:
            rows = gathered.withColumn("game", F.expr(rules.opening(keep)))
        else:
            rows = live.select("user_id", "game").join(gathered, "user_id")
        played = rows.select("user_id", F.expr(rules.playout("choices", keep, "game")).alias("game"), "n_events")
        more = (F.col("n_events") > (k + 1) * segment) & ~F.expr(rules.is_over("game.state"))
        played.select("user_id", "game", more.alias("more")).write.parquet(f"{folder}/round-{k}")
        done = spark.read.parquet(f"{folder}/round-{k}")
        ended.append(done.filter("not more").select("user_id", "game"))
        live = done.filter("more")
        k += 1
        if live.isEmpty():
            break
    games = ended[0]
    for rows in ended[1:]:
        games = games.unionByName(rows)
    return games
