"""What a query's plan must not do twice, or in one task."""

from plyframe import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_requests_are_parsed_once(spark):
    """one cut into fields for the metadata and one for the lines, one into lines."""
    assert plan(spark, "gate_errors").count("split(") == 3


def test_games_of_a_difference_are_folded_once(spark):
    """both sides read the half-moves that one fold told."""
    assert "collect_list" not in plan(spark, "replay_difference")


def test_a_read_is_compared_with_one_move(spark):
    """not with all nine, written out."""
    assert "array_contains(transform(" not in plan(spark, "raw_legality")


def test_boxes_are_made_in_many_tasks(spark):
    """a small file of pages is dealt out before its boxes are made."""
    for name in ("layout_cells", "layout_diagram"):
        assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4
