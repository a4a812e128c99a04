"""The beam of rows against the fold of one row, and against a plain search."""

import pytest
from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.operators import decode, wide_beam
from plyframe.plans import adapters, prob_queries
from tests.test_decode import beam

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dists(spark):
    rows = adapters.plies163(spark, SF).join(prob_queries.checks(spark, SF), ["game", "ply"], "left")
    return rows.filter("game < 4 and ply < 22").cache()


def test_outcome_tells_what_play_does(spark):
    told = adapters.plies(spark, SF).select(F.expr(rules.outcome("before", "action")).alias("o"), "notation", "captured", F.expr(rules.is_over("after")).alias("over"))
    assert told.filter("o.notation <> notation or o.captured <> captured or o.over <> over").count() == 0 and told.filter("over").count() > 0


@pytest.mark.parametrize("width, spread", [(1, False), (16, False), (16, True)])
def test_equals_the_fold_with_evidence(spark, dists, width, spread, monkeypatch):
    if not spread:
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    results = spark.range(4).select(F.col("id").alias("game"), F.expr("int(id) - 1").alias("result"))
    got = {r.game: (r.moves, [round(x, 9) for x in r.shares], round(r.logp, 8), r.state) for r in wide_beam.wide_beam(dists, width, results=results, levels=3).collect()}
    q = F.struct("ply", F.struct("p", F.expr(decode.marginals("p")).alias("marg"), F.col("check").cast(decode.CHECK).alias("check")).alias("q"))
    whole = dists.groupBy("game").agg(F.array_sort(F.collect_list(q)).alias("d")).select("game", F.expr(decode.beam("d.q", width)).alias("b"))
    want = {r.game: (r.h.moves, [round(x, 9) for x in r.h.shares], round(r.h.logp, 8), r.h.state) for r in whole.select("game", F.expr(decode.beam_final("b", "int(game) - 1")).alias("h")).collect()}
    assert got == want and len(got) == 4


def test_a_width_of_1024_equals_a_plain_search(spark, dists):
    few = dists.filter("game = 1 and ply < 6").withColumn("check", F.lit(None).cast(decode.CHECK))
    best = beam([r.p for r in few.orderBy("ply").collect()], 1024)[0]
    got = wide_beam.wide_beam(few, 1024).first()
    assert got.moves == best[1] and got.logp == pytest.approx(best[2], abs=1e-9)


def test_games_end_and_have_widths_of_their_own(spark):
    """Boards near the end: finished hypotheses stay, and short games wait for long ones."""
    rows = adapters.plies163(spark, SF).filter("game < 3 and ply < 4 + game * 2").withColumns({"check": F.lit(None).cast(decode.CHECK), "width": F.col("game") * 4 + 1})
    got = {r.game: r for r in wide_beam.wide_beam(rows, 9).collect()}
    assert {g: len(r.moves) for g, r in got.items()} == {0: 4, 1: 6, 2: 8}
    for game, r in got.items():
        plies = [x.p for x in rows.filter(F.col("game") == game).orderBy("ply").collect()]
        assert r.moves == beam(plies, game * 4 + 1)[0][1]
    assert wide_beam.wide_beam(rows.filter("game < 0"), 4).count() == 0
