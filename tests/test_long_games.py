"""Games folded in segments against games folded whole."""

import pytest
from pyspark.sql import functions as F

from plyframe.operators import long_games

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    """User 0 also has as many later events as all others have."""
    own = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id")
    extra = own.select(F.lit(0).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 1000 days")).alias("ts"), (F.col("event_id") + 10**6).alias("event_id"))
    return own.unionByName(extra)


@pytest.mark.parametrize("keep", [None, "moves"])
def test_segments_equal_the_whole_fold(spark, events, keep):
    whole = {r.user_id: r.game for r in long_games.fold_games(events, keep, segment=10**6).collect()}
    cut = {r.user_id: r.game for r in long_games.fold_games(events, keep, segment=16).collect()}
    assert whole == cut and len(whole) == 15


def test_first_plies_only(spark, events):
    whole = {r.user_id: r.game for r in long_games.fold_games(events, "moves", segment=10**6, first=23).collect()}
    assert whole == {r.user_id: r.game for r in long_games.fold_games(events, "moves", segment=7, first=23).collect()}
    assert max(g.n for g in whole.values()) == 23


def test_no_row_has_more_than_a_segment(spark, events, monkeypatch):
    seen, plain = [], long_games._gathered

    def watched(rows, order, value, parts):
        got = plain(rows, order, value, parts)
        seen.append(got.agg(F.max(F.size("choices"))).first()[0])
        return got

    monkeypatch.setattr(long_games, "_gathered", watched)
    rounds = long_games.fold_games(events, None, segment=32)
    assert rounds.count() == 15 and max(seen) == 32
    # User 0 has over 1000 events, but its game is over long before.
    assert len(seen) < 12
