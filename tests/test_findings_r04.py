"""Findings of the fourth round: the wide beam's memory, documents and agreement at its width."""

import json
import tracemalloc

import numpy as np
import pytest

from plyframe import catalog
from plyframe.operators import boards, sheets
from plyframe.plans import sheet_queries
from tests.test_sheets import search
from tests.test_whole_games import pick

SF = "/root/testdata/sf0.001"


def test_evidence_has_no_copy_of_a_diagram_for_each_child():
    """4 games of 1,024 hypotheses have some 30,000 children, of 14 KB each before."""
    rng = np.random.default_rng(4)
    p = rng.random((4 * 6, 163))
    d = rng.random((4, 20, 85))
    tracemalloc.start()
    try:
        found = boards.beams(p / p.sum(axis=1, keepdims=True), np.arange(0, 25, 6), np.full(4, 1024), 9, np.full(4, 9), {6: (np.arange(4), d, np.ones((4, 20), bool))})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.diff(found.offsets).tolist() == [6] * 4
    assert peak < 60e6


@pytest.fixture(scope="module")
def documents(spark):
    return {r.sheet: json.loads(r.json) for r in catalog.QUERIES["game_documents"](spark, SF).collect()}


def test_documents_have_the_wide_beam(spark, documents):
    """a plain search with 1,024 hypotheses says the same; one alone does not."""
    checks = {}
    for r in sheets.checkpoints(sheet_queries.diagrams(spark, SF).filter("sheet = 5")).collect():
        checks.setdefault(r.ply, {})[r.k] = r.d
    dists = [c.p for c in sheets.readable(sheet_queries.cells(spark, SF).filter("sheet = 5")).first().plies]
    greedy, best = (pick(*search(dists, width, checks), None) for width in (1, 1024))
    beam = documents[5]["beam"]
    assert [m["chosen"] for m in beam["moves"]] == best[1] != greedy[1]
    assert [m["prob"] for m in beam["moves"]] == pytest.approx(best[3], abs=1e-4)
    assert beam["log_prob"] == pytest.approx(best[2], abs=2e-3)


def test_agreement_is_of_the_wide_beam(spark, documents):
    """the moves compared are those of the documents' beam."""
    want = {sheet: (d["beam"]["plies"], sum(m["agrees_with_raw"] for m in d["beam"]["moves"])) for sheet, d in documents.items()}
    assert {r.sheet: (r.compared, r.agree) for r in catalog.QUERIES["raw_vs_beam"](spark, SF).collect()} == want
