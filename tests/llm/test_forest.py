"""The forest: paths sort as tries do, prefixes shorten by what is met, recall on a sample."""

import numpy as np
from pyspark.sql import functions as F

from plyframe.llm import jaccard_join as jj
from plyframe.llm._shared import written

from .test_operators import near_truth, prose


def sketched(spark, rows):
    words = jj.word_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    classes = written(words.select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"), "words"), "test-classes")
    return classes, written(classes.select("rep", "words").mapInArrow(jj._sketches(5), "rep long, paths binary, bytes long"), "test-sketches")


def changed(text, every, tag):
    return " ".join(f"{tag}{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def test_prefixes_shorten_whatever_is_found(spark):
    """Close copies alone: pairs at the threshold would still be met as asked."""
    rows = [(10 * i + k, prose(400, i) if not k else prose(400, i) + f" last{k}") for i in range(6) for k in range(3)]
    classes, sketches = sketched(spark, rows)
    found, depths = jj.forest_links(classes, sketches, 5, 0.8, 0.9999, 512)
    assert depths == [jj.DEPTH, jj.forest_depth(0.8, 0.9999)]
    assert 1 - (1 - 0.8 ** depths[-1]) ** jj.TREES >= 0.9999
    links, _ = near_truth(rows)
    assert dict(found.groupBy("rep").agg(F.sum("texts")).collect()) == {i: n for (i, _), n in zip(rows, links) if n}


def test_links_at_the_threshold_shorten_the_prefix(spark):
    rows = [(10 * i, prose(400, i)) for i in range(30)] + [(10 * i + 1, changed(prose(400, i), 45, "x")) for i in range(30)]
    classes, sketches = sketched(spark, rows)
    found, depths = jj.forest_links(classes, sketches, 5, 0.8, 0.9999, 512)
    assert depths[0] == jj.DEPTH and depths[-1] == jj.forest_depth(0.8, 0.9999) < jj.DEPTH
    got = dict(found.groupBy("rep").agg(F.sum("texts")).collect())
    links, _ = near_truth(rows)
    assert sum(links) > 0 and got == {i: n for (i, _), n in zip(rows, links) if n}


def test_recall_on_a_sample(spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    links, groups = near_truth(rows)
    got = {r.id: (r.n_links, r.group_id) for r in jj.near_groups(sample).collect()}
    recall = sum(got[i][0] for i, _ in rows) / sum(links)
    print(f"recall {recall} of {sum(links)} links")
    assert recall >= 0.999 and all(got[i][0] <= n for (i, _), n in zip(rows, links))
    assert np.mean([got[i][1] == g for (i, _), g in zip(rows, groups)]) >= 0.999


def test_paths_sort_and_cut_like_tries():
    rng = np.random.default_rng(1)
    signature = rng.integers(0, 1 << 32, (40, jj.TREES * jj.DEPTH), dtype=np.uint64).astype(np.uint32)
    signature[20:] = signature[:20]
    signature[20:, 3 :: jj.DEPTH] ^= np.uint32(1 << 31)
    paths = jj.trie_paths(signature)
    for depth in range(1, jj.DEPTH + 1):
        labels = jj.prefix_labels(paths, depth)
        assert (labels[:20] == labels[20:]).all() == (depth <= 3)
        assert len(np.unique(labels[:20, 0])) == 20
