"""Labelled samples are a function of seed and number."""

import pytest

from plyframe.operators import reading
from plyframe.sources import samples


def rows(df):
    return [tuple(r) for r in df.orderBy("sample").collect()]


def test_partitions_and_length_change_nothing(spark):
    base = rows(samples.samples(spark, 1000, 7, partitions=1))
    assert rows(samples.samples(spark, 1000, 7, partitions=13)) == base
    assert rows(samples.samples(spark, 20_000, 7, partitions=3))[:1000] == base
    assert rows(samples.samples(spark, 1000, 8)) != base
    assert [r[0] for r in base] == list(range(1000)) and all(reading.MOVE_CLASSES[k] == c for _, k, c in base)


def test_draws_are_even_over_the_classes(spark):
    counts = samples.samples(spark, 8500, 1, task="diagrams").groupBy("class").count().collect()
    assert len(counts) == 85 and min(r["count"] for r in counts) > 50 and max(r["count"] for r in counts) < 160


def test_classes_of_ones_own_no_seed_and_no_rows(spark):
    got = rows(samples.samples(spark, 50, 3, ["a, b", "é"]))
    assert {c for *_, c in got} == {"a, b", "é"}
    assert rows(samples.samples(spark, 300)) != rows(samples.samples(spark, 300))
    assert rows(samples.samples(spark, 0, 1)) == [] and rows(samples.samples(spark, 2, 1, partitions=8)) == rows(samples.samples(spark, 2, 1, partitions=1))
    with pytest.raises(Exception):
        samples.samples(spark, 3, 1, []).collect()
