"""The sowing game: golden replay, special boards, and properties against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from plyframe.functions import rules

GOLDEN = "98 22 87 12 76 25 65 13 93 25 54".split()


def state(pits, tuz=(-1, -1), turn=0, kazans=(0, 0)):
    ints = lambda xs: "array(" + ",".join(map(str, xs)) + ")"
    return f"named_struct('pits', {ints(pits)}, 'kazans', {ints(kazans)}, 'tuz', {ints(tuz)}, 'turn', {turn})"


def value(spark, sql):
    return spark.range(1).select(F.expr(sql).alias("x")).first().x


def test_golden_replay(spark):
    moves = "array(" + ",".join(f"'{m}'" for m in GOLDEN) + ")"
    row = spark.range(1).select(F.expr(rules.replay(moves)).alias("r")).select("r.*", F.expr(rules.winner("r.state")).alias("w"), F.expr(rules.side_total("r.state", 0)).alias("a"), F.expr(rules.side_total("r.state", 1)).alias("b"), F.expr(rules.pgn("transform(r.played, m -> rtrim('+', m))")).alias("pgn")).first()
    assert (row.state.kazans, row.state.tuz, row.w, row.a, row.b, row.stopped) == ([88, 10], [-1, -1], 0, 42, 22, None)
    assert row.pgn == "1. 98 22\n2. 87 12\n3. 76 25\n4. 65 13\n5. 93 25\n6. 54\n"


def test_first_position_has_nine_moves(spark):
    assert value(spark, rules.legal(rules.START)) == list(range(9))


def test_tuzdyk_made_blocks_and_collects(spark):
    move = value(spark, rules.play(state([9] * 8 + [3], turn=0).replace("array(9,9,9,9,9,9,9,9,3)", "array(" + ",".join(map(str, [9] * 8 + [3] + [2, 2] + [9] * 7)) + ")"), "8"))
    assert move.notation == "92x" and move.state.tuz == [1, -1] and move.state.kazans == [3, 0] and move.state.pits[10] == 0
    after = state(move.state.pits, move.state.tuz, 1, move.state.kazans)
    assert 1 not in value(spark, rules.legal(after))
    then = value(spark, rules.play(after, "0"))
    assert then.notation == "13" and then.state.kazans[0] == 4 and then.state.pits[10] == 0


@pytest.mark.parametrize(
    "pits, tuz, action, notation",
    [
        ([9] * 8 + [4] + [9, 9, 2] + [9] * 6, (-1, 2), 8, "93"),  # no mirror
        ([9] * 8 + [10] + [9] * 8 + [2], (-1, -1), 8, "99"),  # never hole 9
    ],
)
def test_no_tuzdyk(spark, pits, tuz, action, notation):
    move = value(spark, rules.play(state(pits, tuz), str(action)))
    assert move.notation == notation and move.state.tuz == list(tuz)


def test_both_may_own_one_but_never_two(spark):
    first = value(spark, rules.play(state([9, 9, 2] + [9] * 6 + [9] * 9, (4, -1), 1), "3"))
    assert first.notation == "43x" and first.state.tuz == [4, 2]
    again = value(spark, rules.play(state([9, 9, 9, 2] + [9] * 5 + [9] * 9, (4, 2), 1), "4"))
    assert not again.makes_tuzdyk


def sown_by_hand(pits, start):
    pits, n = list(pits), pits[start]
    pits[start] = 0
    at = start + 1 if n == 1 else start
    for _ in range(n):
        pits[at % 18] += 1
        at += 1
    return pits


def test_sowing_equals_a_loop_and_keeps_stones(spark):
    rng = random.Random(3)
    boards = [[rng.randint(0, 40) for _ in range(18)] for _ in range(300)]
    df = spark.createDataFrame([(b, rng.choice([i for i in range(18) if b[i]])) for b in boards], "pits array<int>, start int")
    for r in df.select("pits", "start", F.expr(rules.sow("pits", "start")).alias("s")).collect():
        assert r.s == sown_by_hand(r.pits, r.start) and sum(r.s) == sum(r.pits)


def test_playout_keeps_162_stones(spark):
    g = spark.range(20).select(F.expr("transform(sequence(1, 90), i -> (id * 31 + i * 17) % 101)").alias("c")).select(F.expr(rules.playout("c")).alias("g"))
    for r in g.select("g.*").collect():
        assert all(sum(p.after.pits) + sum(p.after.kazans) == 162 for p in r.plies)
        assert all(p.action in range(9) for p in r.plies)


def test_illegal_notation_stops(spark):
    r = value(spark, rules.replay("array('98', '97', '11')"))
    assert r.stopped == "97" and r.played == ["98+"]


def test_no_moves_is_one_line_end(spark):
    assert value(spark, rules.pgn("cast(array() as array<string>)")) == "\n"
