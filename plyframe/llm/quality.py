"""Quality by histogram gradient-boosted trees over document statistics.

A document is described by FEATURES, all from its bytes: sizes, shares of kinds of
characters, of words and of lines, and how much repeats.  Training values are cut into at
most `bins` quantile bins per feature; a tree grows level by level, all nodes of a
level from one histogram of gradients by (feature, node, bin), the best split
of each node read from its running sums.  Trees are flattened into arrays
(feature, threshold, left child, value), and a batch of documents goes down all
trees at once, one level a step.

The fit uses at most about `max_train_docs` labelled rows, chosen by a hash of their id
(all, if there are fewer); several labels of an id count as the greatest.  Scores
read whole texts.  Null and empty texts have statistics of 0 and are scored by
the trees like others; so are null ids.  Equal texts get equal scores.  Very long
texts are read as they are; a 100 MB text takes about a GB of its task while it is
in work.  With labels of one kind only (or none) every score is that label (or 0.5).  Columns
other than id, text and label are not looked at, so their names can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import byte_buffer, slices, span_hashes, text_or_empty, word_spans

TREES, DEPTH, BINS, RATE, RIDGE, MIN_WEIGHT = 80, 5, 64, 0.1, 1.0, 2.0

FEATURES = (
    "log_bytes", "log_words", "log_lines",
    "letters", "capitals", "digits", "blanks", "marks", "symbols", "other_bytes",
    "word_bytes", "word_spread", "longest_word", "one_byte_words", "words_without_letters", "words_ending_in_mark", "words_ending_in_symbol", "words_with_capital",
    "distinct_words", "commonest_word", "repeated_pairs",
    "line_words", "short_lines", "ended_lines", "repeated_lines",
    "sentence_words", "entropy",
)

_LETTER, _CAPITAL, _DIGIT, _BLANK, _MARK, _SYMBOL, _OTHER = range(7)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[128:] = _OTHER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _CAPITAL
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[*b" \t\n\x0b\x0c\r"]] = _BLANK
_KIND[[*b".,;:!?'\"()-"]] = _MARK
_WORD = _KIND != _BLANK
_LETTERS = np.isin(_KIND, (_LETTER, _CAPITAL, _OTHER))
_END = np.isin(np.arange(256), [*b".!?"])
_IN_LINE = np.arange(256) != 10


def _per(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flag over each [at[i], at[i+1])."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _repeats(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different values, and how often the commonest is there."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    often = np.diff(np.append(head, len(row)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[head], often)
    return np.bincount(row[head], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text, [texts, features]."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    # How often each byte is in each text; all shares of bytes come from it.
    table = np.bincount(np.repeat(np.arange(n) << 8, size) + data, minlength=n << 8).reshape(n, 256) if n else np.zeros((0, 256), np.int64)
    starts, ends, at = word_spans(data, offsets, _WORD)
    words, length = np.diff(at), ends - starts
    text = np.repeat(np.arange(n), words)
    first, last, _ = word_spans(data, offsets, _IN_LINE)
    line_text = np.searchsorted(offsets, first, side="right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    kinds = [table[:, _KIND == k].sum(axis=1) for k in range(7)]
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_LETTERS[data], out=letters[1:], dtype=np.int32)
    ending = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    mean = _share(_per(length, at), words)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    distinct, top = _repeats(text, hashes, n)
    inner = text[1:] == text[:-1]
    pairs, _ = _repeats(text[1:][inner], (hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1])[inner], n)
    line_kinds, _ = _repeats(line_text, span_hashes(data, first, last) if len(first) else np.zeros(0, np.uint64), n)
    sentences = _per(_END[data[ends - 1]] if len(ends) else np.zeros(0, bool), at)
    share = table / np.maximum(size, 1)[:, None]
    columns = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(words),
        "log_lines": np.log1p(lines),
        "letters": _share(kinds[_LETTER] + kinds[_CAPITAL], size),
        "capitals": _share(kinds[_CAPITAL], size),
        "digits": _share(kinds[_DIGIT], size),
        "blanks": _share(kinds[_BLANK], size),
        "marks": _share(kinds[_MARK], size),
        "symbols": _share(kinds[_SYMBOL], size),
        "other_bytes": _share(kinds[_OTHER], size),
        "word_bytes": mean,
        "word_spread": np.sqrt(np.maximum(_share(_per(length.astype(np.int64) ** 2, at), words) - mean**2, 0)),
        "longest_word": np.log1p(np.maximum.reduceat(np.append(length, 0), np.minimum(at[:-1], len(length))) * (words > 0)) if n else np.zeros(0),
        "one_byte_words": _share(_per(length == 1, at), words),
        "words_without_letters": _share(_per(letters[ends] == letters[starts], at), words),
        "words_ending_in_mark": _share(_per(ending == _MARK, at), words),
        "words_ending_in_symbol": _share(_per(ending == _SYMBOL, at), words),
        "words_with_capital": _share(_per(_KIND[data[starts]] == _CAPITAL if len(starts) else np.zeros(0, bool), at), words),
        "distinct_words": _share(distinct, words),
        "commonest_word": _share(top, words),
        "repeated_pairs": 1 - _share(pairs, np.maximum(words - 1, 1)) * (words > 1) - (words <= 1),
        "line_words": _share(words, lines),
        "short_lines": _share(np.bincount(line_text[line_words < 5], minlength=n), lines),
        "ended_lines": _share(np.bincount(line_text[_END[data[last - 1]]] if len(last) else np.zeros(0, np.int64), minlength=n), lines),
        "repeated_lines": _share(lines - line_kinds, lines),
        "sentence_words": _share(words, np.maximum(sentences, 1)),
        "entropy": -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1),
    }
    return np.stack([columns[name] for name in FEATURES], axis=1).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


# ---------------------------------------------------------------- trees


@dataclass
class Forest:
    """Trees as arrays: a node's left child is left[node], its right one left[node] + 1;
    a leaf is its own child (threshold infinity)."""

    root: np.ndarray  # [trees]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(self.root):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = self.left[node] + (x[row, self.feature[node]] > self.threshold[node])
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature at most bins - 1 edges; a value v is in the bin of the first edge >= v."""
    found = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            found.append(values)
        else:
            found.append((values[1:] + values[:-1]) / 2)
    return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost the log-odds of y (0/1) by `trees` trees."""
    n, f = x.shape
    rate_of_ones = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    nodes: dict[str, list] = {"root": [], "feature": [], "threshold": [], "left": [], "value": []}
    if n and 0 < y.mean() < 1:
        edges = bin_edges(x, bins)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        most = max(len(e) for e in edges) + 1
        # The last bin of a feature has no split to its right.
        allowed = np.arange(most)[None, :] < np.array([len(e) for e in edges])[:, None]
        logit = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            logit = logit + _grow(nodes, binned, edges, allowed, p - y, p * (1 - p), depth, rate)
    return Forest(np.array(nodes["root"], np.int64), np.array(nodes["feature"], np.int64), np.array(nodes["threshold"], float), np.array(nodes["left"], np.int64), np.array(nodes["value"], float), base, depth)


def _grow(nodes: dict[str, list], binned: np.ndarray, edges: list[np.ndarray], allowed: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> np.ndarray:
    """Add one tree to `nodes`; its value for each training row."""
    f, n = binned.shape
    most = allowed.shape[1]

    def leaf(gradient: float, weight: float) -> int:
        at = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("value", -rate * gradient / (weight + RIDGE))):
            nodes[name].append(v)
        return at

    nodes["root"].append(leaf(g.sum(), h.sum()))
    level, where = [nodes["root"][-1]], np.zeros(n, np.int64)  # a row's node in the level, -1: done
    out = np.full(n, nodes["root"][-1])
    for _ in range(depth):
        live = where >= 0
        k = len(level)
        cell = where[live] * most
        sums = np.array([[np.bincount(cell + b[live], v[live], k * most).reshape(k, most) for v in (g, h)] for b in binned])  # [f, 2, k, most]
        left = np.cumsum(sums, axis=3)
        total = left[:, :, :, -1:]
        right = total - left
        gain = left[:, 0] ** 2 / (left[:, 1] + RIDGE) + right[:, 0] ** 2 / (right[:, 1] + RIDGE) - total[:, 0] ** 2 / (total[:, 1] + RIDGE)
        gain[(left[:, 1] < MIN_WEIGHT) | (right[:, 1] < MIN_WEIGHT) | ~allowed[:, None, :]] = -1
        best = gain.transpose(1, 0, 2).reshape(k, -1)
        pick = best.argmax(axis=1)
        grown, place = [], np.full(k, -1)
        split_feature, split_bin = pick // most, pick % most
        for i in range(k):
            if best[i, pick[i]] <= 1e-9:
                continue
            j, b = int(split_feature[i]), int(split_bin[i])
            place[i] = len(grown)
            kids = [leaf(*side[j, :, i, b]) for side in (left, right)]
            nodes["feature"][level[i]], nodes["threshold"][level[i]], nodes["left"][level[i]] = j, float(edges[j][b]), kids[0]
            grown += kids
        if not grown:
            break
        rows = np.flatnonzero(live)
        mine = where[rows]
        goes = place[mine] >= 0
        where[rows[~goes]] = -1
        rows, mine = rows[goes], mine[goes]
        where[rows] = place[mine] + (binned[split_feature[mine], rows] > split_bin[mine])
        out[rows] = np.array(grown)[where[rows]]
        level = grown
    return np.array(nodes["value"])[out]


# ---------------------------------------------------------------- on Spark


def described(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the columns `carry` as a struct, and the statistics as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = statistics(*byte_buffer(batch.column("text")))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("carry"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["carry", "x"])

    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), *carry).alias("carry"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"carry {rows.schema['carry'].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_docs: int = 20_000) -> Forest:
    """Fit on labelled rows where `usable` (a condition on the id) holds."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")).filter(usable)
    n = chosen.count()
    if n > max_train_docs:
        draw = F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col)), F.lit(1 << 30))
        chosen = chosen.filter(draw < int(max_train_docs / n * (1 << 30)))
    rows = described(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), ["label"], id_col, text_col)
    # Some max_train_docs rows of len(FEATURES) numbers.
    got = rows.select("carry.id", "carry.label", "x").orderBy("id").toArrow().combine_chunks()
    x = np.array(got.column("x").combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    return fit(x, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees * 2^(depth + 1) nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                got = shared.value.scores(statistics(*byte_buffer(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got)], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, score double")
