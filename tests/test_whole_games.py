"""The registered beam queries decode every ply of each game."""

import math

import pytest

from plyframe import catalog
from plyframe.plans import adapters
from tests.test_decode import legal, play

SF = "/root/testdata/sf0.001"
START = ([9] * 18, [0, 0], [-1, -1], 0)


def over(g):
    return max(g[1]) >= 82 or not legal(g)


def consistency(g, stated):
    """0, 1 or 2 for a stated result (0, 1 or -1); 1 for a finished game without one."""
    if stated is None:
        return int(over(g))
    total = [k + (sum(g[0][9 * s : 9 * s + 9]) if max(g[1]) < 82 and g[3] != s and not legal(g) else 0) for s, k in enumerate(g[1])]
    leads = lambda t: 0 if t[0] > t[1] else 1 if t[1] > t[0] else -1
    return 2 if over(g) and leads(total) == stated else int(leads(g[1]) == stated)


def search(dists, width):
    """active and finished hypotheses (state, moves, logp) after all plies."""
    active, finished = [(START, [], 0.0)], []
    for p in dists:
        src = [sum(p[18 * s : 18 * s + 18]) for s in range(9)]
        land = [sum(p[18 * s + 2 * e] + p[18 * s + 2 * e + 1] for s in range(9)) for e in range(9)]
        x, pool = sum(p[1:162:2]), []
        for g, moves, logp in active:
            kids = []
            for a in legal(g):
                new, note, got = play(g, a)
                own = p[2 * (9 * (int(note[0]) - 1) + int(note[1]) - 1) + note.endswith("x")]
                kids.append(((0.5 * own + 0.5 * src[a] * land[int(note[1]) - 1] * 9) * (x if note.endswith("x") else 1 - x), a, new, note + "+" * (got > 0)))
            for s, _, new, note in sorted(kids, key=lambda k: (-k[0], k[1])):
                (finished if over(new) else pool).append((new, [*moves, note], logp + math.log(max(s, 1e-12))))
        if not pool:
            break
        active = sorted(pool, key=lambda h: -h[2])[:width]
    return active, finished


def pick(active, finished, stated):
    return max(active + finished, key=lambda h: (len(h[1]), consistency(h[0], stated), h[2]))


@pytest.fixture(scope="module")
def dists(spark):
    games = {}
    for r in adapters.plies163(spark, SF).orderBy("game", "ply").collect():
        games.setdefault(r.game, []).append(r.p)
    assert max(map(len, games.values())) == 40
    return games


@pytest.mark.parametrize("name, width", [("beam_w1", 1), ("beam_w16", 16)])
def test_all_plies_are_decoded(spark, dists, name, width):
    got = {r.game: r for r in catalog.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(dists)
    for game, ps in dists.items():
        active, finished = search(ps, width)
        best = pick(active, finished, None)
        assert got[game].moves == " ".join(best[1])
        assert got[game].pits == ",".join(map(str, best[0][0]))
        assert got[game].best_logp == pytest.approx(max(h[2] for h in active + finished), abs=1e-3)


def test_final_pick_is_of_whole_games(spark, dists):
    got = {r.game: r.moves for r in catalog.QUERIES["beam_final"](spark, SF).collect()}
    for game, ps in dists.items():
        active, finished = search(ps, 8)
        assert got[game] == " ".join(pick(active, finished, game % 3 - 1)[1])
