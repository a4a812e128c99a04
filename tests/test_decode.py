"""Beam decoding against a plain search in Python."""

import math

import pytest
from pyspark.sql import functions as F

from plyframe.functions import rules
from plyframe.operators import decode
from plyframe.plans import adapters

SF = "/root/testdata/sf0.001"


def sow(pits, start):
    pits, n = list(pits), pits[start]
    pits[start] = 0
    at = start + (n == 1)
    for k in range(n):
        pits[(at + k) % 18] += 1
    return pits, (at + n - 1) % 18


def legal(g):
    pits, _, tuz, turn = g
    return [a for a in range(9) if pits[turn * 9 + a] and tuz[1 - turn] != a]


def play(g, a):
    pits, kazans, tuz, turn = g
    pits, last = sow(pits, turn * 9 + a)
    kazans, tuz = list(kazans), list(tuz)
    for s in (0, 1):
        if tuz[s] >= 0:
            i = 9 * (1 - s) + tuz[s]
            kazans[s] += pits[i]
            pits[i] = 0
    note, got = f"{a + 1}{last % 9 + 1}", 0
    if last // 9 == 1 - turn:
        if pits[last] == 3 and tuz[turn] < 0 and last % 9 != 8 and tuz[1 - turn] != last % 9:
            tuz[turn], note = last % 9, note + "x"
            kazans[turn] += 3
            pits[last] = 0
        elif pits[last] % 2 == 0:
            got = pits[last]
            kazans[turn] += got
            pits[last] = 0
    return (pits, kazans, tuz, 1 - turn), note, got


def beam(dists, width):
    active = [(([9] * 18, [0, 0], [-1, -1], 0), [], 0.0)]
    for p in dists:
        src = [sum(p[18 * s : 18 * s + 18]) for s in range(9)]
        land = [sum(p[18 * s + 2 * e] + p[18 * s + 2 * e + 1] for s in range(9)) for e in range(9)]
        x = sum(p[1:162:2])
        pool = []
        for g, moves, logp in active:
            kids = []
            for a in legal(g):
                new, note, got = play(g, a)
                own = p[2 * (9 * (int(note[0]) - 1) + int(note[1]) - 1) + note.endswith("x")]
                kids.append(((0.5 * own + 0.5 * src[a] * land[int(note[1]) - 1] * 9) * (x if note.endswith("x") else 1 - x), a, new, note + "+" * (got > 0)))
            for s, _, new, note in sorted(kids, key=lambda k: (-k[0], k[1])):
                pool.append((new, [*moves, note], logp + math.log(max(s, 1e-12))))
        active = sorted(pool, key=lambda h: -h[2])[:width]
    return active


@pytest.mark.parametrize("width, plies", [(1, 24), (16, 12)])
def test_beam_against_plain_search(spark, width, plies):
    rows = adapters.plies163(spark, SF).filter(F.col("ply") < plies)
    q = F.struct("ply", F.struct("p", F.expr(decode.marginals("p")).alias("marg"), F.lit(None).cast(decode.CHECK).alias("check")).alias("q"))
    decoded = rows.groupBy("game").agg(F.array_sort(F.collect_list(q)).alias("d")).select("game", F.expr(decode.beam("d.q", width)).alias("b"))
    got = {r.game: r.h for r in decoded.select("game", F.expr(decode.beam_final("b", "cast(null as int)")).alias("h")).collect()}
    games = {}
    for r in rows.orderBy("game", "ply").collect():
        games.setdefault(r.game, []).append(r.p)
    for game, dists in games.items():
        best = beam(dists, width)
        assert got[game].logp == pytest.approx(best[0][2], abs=1e-3)
        assert got[game].moves == best[0][1]


def test_start_is_even(spark):
    assert spark.range(1).select(F.expr(rules.winner(rules.START)).alias("w")).first().w == -1
