"""Tables compared field by field."""

from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.operators import difference
from plyframe.sources import files

#: Two lines above the header, and the golden game's half-moves in all fields.
HEAD = """half-moves\t11
start\t81\t81\t0\t0
halfmove\tplayer\tmove\tp1_kazan\tp2_kazan\tp1_side\tp2_side\tp1_tuzdyk\tp2_tuzdyk\twinner
"""
GOLDEN = """
1 P1 98 10 0 73 79 -1 -1 ongoing
2 P2 22 10 10 65 77 -1 -1 ongoing
3 P1 87 22 10 58 72 -1 -1 ongoing
4 P2 12 22 10 60 70 -1 -1 ongoing
5 P1 76 36 10 54 62 -1 -1 ongoing
6 P2 25 36 10 54 62 -1 -1 ongoing
7 P1 65 52 10 49 51 -1 -1 ongoing
8 P2 13 52 10 49 51 -1 -1 ongoing
9 P1 93 70 10 46 36 -1 -1 ongoing
10 P2 25 70 10 46 36 -1 -1 ongoing
11 P1 54 88 10 42 22 -1 -1 P1
"""
MOVES = "98 22 87 12 76 25 65 13 93 25 54".split()


def replayed(spark, moves):
    """The half-moves of a game with the fields of the fixture."""
    state, rows = f"{rules.START}", []
    df = spark.createDataFrame([(i + 1, moves[: i + 1]) for i in range(len(moves))], "halfmove int, moves array<string>")
    r = df.select("halfmove", F.element_at("moves", -1).alias("move"), F.expr(rules.replay("moves")).alias("r"))
    sides = [F.expr(rules.side_total("r.state", k)).alias(f"p{k + 1}_side") for k in (0, 1)]
    won = F.expr(f"if({rules.is_over('r.state')}, element_at(array('P1', 'P2', 'draw'), if({rules.winner('r.state')} < 0, 3, {rules.winner('r.state')} + 1)), 'ongoing')")
    return r.select("halfmove", F.when(F.col("halfmove") % 2 == 1, "P1").otherwise("P2").alias("player"), "move", F.col("r.state.kazans")[0].alias("p1_kazan"), F.col("r.state.kazans")[1].alias("p2_kazan"), *sides, F.col("r.state.tuz")[0].alias("p1_tuzdyk"), F.col("r.state.tuz")[1].alias("p2_tuzdyk"), won.alias("winner"))


def fixture(spark, tmp_path, rows):
    path = str(tmp_path / "replay.tsv")
    with open(path, "w") as out:
        out.write(HEAD + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return files.replay_tsv(spark, path)


def test_golden_half_moves_agree_in_all_fields(spark, tmp_path):
    told = fixture(spark, tmp_path, [line.split() for line in GOLDEN.split("\n") if line])
    assert told.count() == 11 and difference.difference(told, replayed(spark, MOVES), ["halfmove"]).count() == 0


def test_a_spoilt_copy_is_reported(spark, tmp_path):
    mine = [tuple(r) for r in replayed(spark, MOVES).orderBy("halfmove").collect()]
    assert mine[-1][3:] == (88, 10, 42, 22, -1, -1, "P1") and mine[0][9] == "ongoing"
    spoilt = [list(r) for r in mine if r[0] != 5]
    spoilt[2][4] += 1
    spoilt[9][9] = "P2"
    got = difference.difference(replayed(spark, MOVES), fixture(spark, tmp_path, spoilt), ["halfmove"]).collect()
    third = mine[2][4]
    assert sorted(map(tuple, got)) == sorted([(3, "p2_kazan", str(third), str(third + 1)), (5, "*", "1", "0"), (11, "winner", "P1", "P2")])


def test_nulls_are_values_and_repeated_keys_are_counted(spark):
    schema = "k string, v int, w string"
    a = spark.createDataFrame([("a", 1, None), (None, 2, "x"), ("b", None, "y"), ("c", 1, "z"), ("c", 1, "z"), ("d", 4, "q"), ("d", 5, "q")], schema)
    b = spark.createDataFrame([("a", 1, None), (None, 2, "x"), ("b", 3, "y"), ("c", 1, "z"), ("d", 4, "q"), ("d", 6, "r"), ("d", 7, "s"), ("e", 1, "n")], schema)
    got = sorted(map(str, map(tuple, difference.difference(a, b, ["k"]).collect())))
    assert got == sorted(map(str, [("b", "v", None, "3"), ("c", "*", "1", "0"), ("d", "*", "1", "2"), ("e", "*", "0", "1")]))
    assert difference.difference(a, a, ["k"]).count() == 0
    assert [tuple(r) for r in difference.difference(a.filter("k = 'b'"), b.filter("k = 'b'"), ["k"], ["w"]).collect()] == []
