"""Input adapters: how the driver's tables stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions import prob, rules
from plyframe.operators import long_games


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _played(spark: SparkSession, sf_dir: str, keep: str | None, only: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """user_id and game: the ids of a user's events in time order choose the moves; with
    `only`, of the users in it."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    if only is not None:
        events = events.join(only, "user_id", "left_semi")
    return long_games.fold_games(events, keep, first=first)


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, final state and number of half-moves: the id of each event in turn
    chooses among the legal moves."""
    return _played(spark, sf_dir, None).select("user_id", "game.state", F.col("game.n").alias("n_plies"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same games: user_id, final state and annotated moves."""
    return _played(spark, sf_dir, "moves").select("user_id", "game.state", "game.moves")


def games(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """The same games with all of their plies; with `first`, those of so many only."""
    return _played(spark, sf_dir, "plies", only, first).select("user_id", "game.state", "game.plies")


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ply and the board g after every 20th half-move; only these are kept."""
    kept = _played(spark, sf_dir, "boards").select("user_id", F.explode_outer("game.boards").alias("b"))
    return kept.filter("b is not null").select("user_id", "b.ply", "b.g")


def plies(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """One row per half-move: user_id and the ply's fields."""
    # explode would infer a filter on the array's size and fold each game once more for it.
    return games(spark, sf_dir, only, first).select("user_id", F.explode_outer("plies").alias("p")).filter("p is not null").select("user_id", "p.*")


def logits64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> double(x))").alias("z"))


def plies163(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions over the 163 move classes: game, ply, p."""
    z = "transform(sequence(0, 162), i -> 8D * z[i % 64] + double((i * 37 + vec_id * 11) % 101) / 50D)"
    # One let-bound expression: a filter pushed below it computes it once more, not
    # once per element.
    p = rules.let("logit", z, prob.softmax("logit"))
    return logits64(spark, sf_dir).select("vec_id", F.expr("vec_id div 40").alias("game"), F.expr("int(vec_id % 40)").alias("ply"), F.expr(p).alias("p"))


def diagrams85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions over the 85 diagram classes: vec_id, p."""
    return logits64(spark, sf_dir).select("vec_id", F.expr(prob.softmax(prob.diagram_logits("z", "vec_id"))).alias("p"))


def diagram_cells(boards: DataFrame, n_vectors: int) -> DataFrame:
    """The 20 cells k of each diagram (user_id, ply) with the vector that stands for it."""
    return boards.select("user_id", "ply", F.explode(F.expr("sequence(0, 19)")).alias("k")).withColumn("vec_id", F.expr(f"(user_id * 13 + ply + k) % {n_vectors}"))
