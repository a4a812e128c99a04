"""Whole sheets: the beam with evidence against a plain search, documents, batches."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plyframe import catalog
from plyframe.operators import decode, sheets
from plyframe.plans import sheet_queries
from tests.test_decode import legal, play
from tests.test_whole_games import START, over, pick

SF = "/root/testdata/sf0.001"


def evidence(g, check):
    pits, kazans, tuz, _ = g
    total = 0.0
    for k, d in check.items():
        if k >= 18:
            n = kazans[k - 18]
            total += math.log(max(d[n] if n < 82 else 0.0, 1e-4))
        else:
            n = pits[k]
            p = d[82] if tuz[1 - k // 9] == k % 9 else d[83] + d[0] if n == 0 else d[n] if n < 82 else 0.0
            total += 0.5 * math.log(max(p, 1e-3))
    return total


def search(dists, width, checks):
    active, finished = [(START, [], 0.0, [])], []
    for i, p in enumerate(dists):
        src = [sum(p[18 * s : 18 * s + 18]) for s in range(9)]
        land = [sum(p[18 * s + 2 * e] + p[18 * s + 2 * e + 1] for s in range(9)) for e in range(9)]
        x, pool = sum(p[1:162:2]), []
        for g, moves, logp, shares in active:
            kids = []
            for a in legal(g):
                new, note, got = play(g, a)
                own = p[2 * (9 * (int(note[0]) - 1) + int(note[1]) - 1) + note.endswith("x")]
                kids.append(((0.5 * own + 0.5 * src[a] * land[int(note[1]) - 1] * 9) * (x if note.endswith("x") else 1 - x), a, new, note + "+" * (got > 0)))
            all_ = sum(k[0] for k in kids) or 1.0
            for s, _, new, note in sorted(kids, key=lambda k: (-k[0], k[1])):
                more = math.log(max(s, 1e-12)) + (evidence(new, checks[i + 1]) if i + 1 in checks else 0.0)
                (finished if over(new) else pool).append((new, [*moves, note], logp + more, [*shares, s / all_]))
        if not pool:
            break
        active = sorted(pool, key=lambda h: -h[2])[:width]
    return active, finished


def test_beam_with_evidence_and_shares(spark):
    checks, plies = {}, {}
    for r in sheets.checkpoints(sheet_queries.diagrams(spark, SF)).collect():
        checks.setdefault(r.sheet, {}).setdefault(r.ply, {})[r.k] = r.d
    assert max(len(c) for c in checks.values()) > 2 and {p for c in checks.values() for p in c} <= set(range(20, 161, 20)) and min(len(x) for c in checks.values() for x in c.values()) < 20
    for r in sheets.readable(sheet_queries.cells(spark, SF)).collect():
        plies[r.sheet] = [c.p for c in r.plies]
    got, likely = {}, {}
    for r in catalog.QUERIES["beam_detail"](spark, SF).orderBy("sheet", "ply").collect():
        got.setdefault(r.sheet, []).append((r.chosen, r.prob))
        likely[r.sheet] = r.log_prob
    assert set(got) == set(plies)
    changed = 0
    for sheet, dists in plies.items():
        best = pick(*[[h for h in hs] for hs in search(dists, 4, checks.get(sheet, {}))], None)
        assert [m for m, _ in got[sheet]] == best[1]
        assert [s for _, s in got[sheet]] == pytest.approx(best[3], abs=1e-4)
        assert likely[sheet] == pytest.approx(best[2], abs=2e-3)
        changed += best[2] != pick(*search(dists, 4, {}), None)[2]
    assert changed > len(plies) / 2


def test_documents(spark):
    docs = {r.sheet: json.loads(r.json) for r in catalog.QUERIES["game_documents"](spark, SF).collect()}
    assert len(docs) == 15
    for sheet, d in docs.items():
        assert d["plies_scanned"] == len(d["plies"]) == len(d["beam"]["moves"]) == d["beam"]["plies"]
        assert d["stopped"]["reason"] == "empty cell" if sheet % 3 == 0 else d["stopped"]["reason"]
        assert all(p["raw"] in p["legal"] for p in d["plies"] if p.get("raw_is_legal"))
        assert all(len(p["top5"]) == 5 for p in d["plies"])


def test_batches_and_caps(spark):
    cells = sheet_queries.cells(spark, SF).filter("sheet < 2 and move_no < 3")  # the beam is as wide as the cap
    read = sheets.read_sheets(cells, width=50_000).select("sheet", "legal_plies", "stopped", F.lit("pgn").alias("beam_pgn"), "warnings")
    assert read.limit(1).collect()[0].warnings == [f"beam width 50000 trimmed to {decode.POOL_BYTES // (decode.BYTES_EACH * 9)} to stay inside the memory budget"]
    images = spark.createDataFrame([(0, 1, 1), (0, 2, 77)], "batch int, n int, sheet long")
    lines = spark.createDataFrame([(0, 2, "w", "b", None), (0, 3, "more", "", None)], "batch int, n int, white string, black string, error string")
    got = {r.n: (r.white, r.error) for r in sheets.batch(images, lines, read).collect()}
    assert got == {1: ("", None), 2: ("w", "no cells were found"), 3: ("more", "more game lines than images")}


def test_no_cells_read_give_an_empty_game(spark):
    blank = spark.createDataFrame([(1, 1, "W", 0.0, [1.0] + [0.0] * 162)], "sheet long, move_no int, side string, ink double, p array<double>")
    r = sheets.read_sheets(blank, width=2).first()
    assert (r.raw_pgn, r.legal_pgn, r.beam_pgn, r.plies_scanned, r.stopped.reason) == ("\n", "\n", "\n", 0, "empty cell")
