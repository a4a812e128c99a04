"""Statistics against plain Python, trees against plain descent, and held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plyframe.llm import quality
from plyframe.llm._shared import byte_buffer, id_bucket

TEXTS = ["", "   ", "One.", "The cat sat. The cat ran!\nThe cat sat. The cat ran!\n\nx", "ähre | straße | 漢字 12,5% ###", "a b a b a b", "\n\nend", "w" * 5000 + " A1 b2\tc", "Tab\there\x0bfeed\x0c."]
WHITE = " \t\n\x0b\x0c\r"


def plain(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    n, share = len(raw), lambda a, b: a / b if b else 0.0
    kind = {"letters": lambda b: chr(b).isascii() and chr(b).isalpha(), "capitals": lambda b: 65 <= b <= 90, "digits": lambda b: 48 <= b <= 57, "blanks": lambda b: b in b" \t\n\x0b\x0c\r", "marks": lambda b: b in b".,;:!?'\"()-", "other_bytes": lambda b: b >= 128}
    out = {name: share(sum(map(test, raw)), n) for name, test in kind.items()}
    out["symbols"] = share(n, n) - sum(out[k] for k in ("letters", "digits", "blanks", "marks", "other_bytes"))
    sizes = [len(w) for w in words]
    mean = share(sum(sizes), len(words))
    pairs = Counter(zip(words, words[1:]))
    counts = Counter(raw)
    of = lambda test: share(sum(map(test, words)), len(words))
    word_lines = [len(re.findall(rb"[^\x20\x09-\x0d]+", x)) for x in lines]
    out |= {
        "log_bytes": math.log1p(n),
        "log_words": math.log1p(len(words)),
        "log_lines": math.log1p(len(lines)),
        "word_bytes": mean,
        "word_spread": math.sqrt(max(share(sum(s * s for s in sizes), len(words)) - mean**2, 0)),
        "longest_word": math.log1p(max(sizes, default=0)),
        "one_byte_words": of(lambda w: len(w) == 1),
        "words_without_letters": of(lambda w: not any(b >= 128 or chr(b).isalpha() for b in w)),
        "words_ending_in_mark": of(lambda w: kind["marks"](w[-1])),
        "words_ending_in_symbol": of(lambda w: not any(kind[k](w[-1]) for k in ("letters", "digits", "marks", "other_bytes"))),
        "words_with_capital": of(lambda w: 65 <= w[0] <= 90),
        "distinct_words": share(len(set(words)), len(words)),
        "commonest_word": share(max(Counter(words).values(), default=0), len(words)),
        "repeated_pairs": 1 - len(pairs) / (len(words) - 1) if len(words) > 1 else 0.0,
        "line_words": share(len(words), len(lines)),
        "short_lines": share(sum(k < 5 for k in word_lines), len(lines)),
        "ended_lines": share(sum(x[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "sentence_words": share(len(words), max(sum(w[-1:] in (b".", b"!", b"?") for w in words), 1)),
        "entropy": -sum(c / n * math.log2(c / n) for c in counts.values()),
    }
    return [out[name] for name in quality.FEATURES]


def test_statistics_equal_plain_python():
    got = quality.statistics(*byte_buffer(pa.array([*TEXTS, None])))
    for text, row in zip([*TEXTS, ""], got):
        assert dict(zip(quality.FEATURES, row)) == pytest.approx(dict(zip(quality.FEATURES, plain(text))), abs=1e-9), text
    assert quality.statistics(*byte_buffer(pa.array([], pa.string()))).shape == (0, len(quality.FEATURES))


def descend(forest, x):
    total = forest.base
    for node in forest.root:
        while forest.left[node] != node:
            node = forest.left[node] + (x[forest.feature[node]] > forest.threshold[node])
        total += forest.value[node]
    return total


def test_flat_trees_equal_a_plain_descent():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=20)
    new = np.round(rng.normal(size=(500, 5)), 1)
    assert forest.logits(new) == pytest.approx([descend(forest, row) for row in new])
    assert np.mean((forest.scores(new) >= 0.5) == ((new[:, 0] > 0) ^ (new[:, 1] > 0.5))) > 0.97
    assert len(forest.root) == 20 and (forest.scores(new) >= 0).all() and (forest.scores(new) <= 1).all()


def test_one_split_is_the_best_one():
    """A tree of depth 1 takes the split of the largest gain, found by trying all."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 2] + rng.normal(0, 0.5, 200) > 0.3).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1, bins=1000)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))
    side = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    gains = {}
    for f in range(3):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            if min(h[left].sum(), h[~left].sum()) >= quality.MIN_WEIGHT:
                gains[f, (a + b) / 2] = side(left) + side(~left)
    assert (forest.feature[0], forest.threshold[0]) == max(gains, key=gains.get)


def test_labels_of_one_kind_or_none():
    x = np.zeros((4, 2))
    assert quality.fit(x, np.ones(4)).scores(x) == pytest.approx(np.ones(4), abs=1e-5)
    assert quality.fit(np.zeros((0, 2)), np.zeros(0)).scores(x) == pytest.approx(np.full(4, 0.5))


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    forest = quality.train(docs, labels, ~held)
    told = quality.score(docs, forest).withColumnRenamed("id", "doc_id").join(labels.filter(held), "doc_id").select((F.col("score") >= 0.5).cast("int").alias("said"), "quality").collect()
    assert len(told) > 1000 and np.mean([r.said == r.quality for r in told]) > 0.98
    odd = spark.createDataFrame([(1, None, 2, "x"), (1, "", 2, "x"), (None, "Two words.", 3, None), (2, "w " * 700_000, 4, "x"), (2, "w " * 700_000, 4, "x")], "doc_id long, text string, score int, x string")
    rows = quality.score(odd, forest).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.id == 2}) == 1
    assert quality.score(odd.limit(0), forest).count() == 0
    again = quality.train(odd, spark.createDataFrame([(1, 0), (1, None), (2, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(odd, again).count() == 5
