"""Neighbouring passages with different first documents."""

from plyframe.llm import substring_dedup

from .test_operators import prose

A, B = prose(100, 71), prose(100, 72)


def test_first_occurrence_next_to_a_copy_stays(spark):
    df = spark.createDataFrame([(1, A), (2, A + " " + B), (3, A + " " + B)], "doc_id long, text string")
    found = {}
    for r in substring_dedup.passage_parts(df).collect():
        found.setdefault(r.doc, []).append((r.start, r.first_doc, r.is_first))
    assert [x[1:] for x in sorted(found[1])] == [(1, True)]
    assert [x[1:] for x in sorted(found[2])] == [(1, False), (2, True)]
    assert [x[1:] for x in sorted(found[3])] == [(1, False), (2, False)]
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(df).collect()}
    assert cut[1] == A and B in cut[2] and len(cut[2]) < len(A) + len(B) - 300 and len(cut[3]) < 100
