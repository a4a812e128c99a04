"""Toxicity by a small convolutional text classifier.

Words are hashed into an embedding table; filters of widths 1, 2 and 3 run over
the embeddings, and each filter's largest value in a text goes through one
logistic layer.  Trained in numpy with Adagrad: through a maximum only the
winning position gets a gradient.  The first number of an embedding starts at
the smoothed log-odds of its word in the training texts, the rest at random.

Thresholds are calibrated by language, and as a language column is no input,
by the language that the text itself shows (a trained language model): on all
labelled rows that the fit has not seen, each language takes the threshold of best
F1, which the score moves to 0.5.  Languages with few positive rows take the
threshold of all.  The counts of rows at or above each logit are running sums of
distinct logits in Spark; the driver gets one row a language.  No text is shuffled: the
ids to fit on go to the texts by a broadcast, and texts give logits before the labels
are joined.

The fit uses at most `max_train_docs` labelled rows, chosen by a hash of their
id, but for a fifth of them (of all, if there are fewer) that thresholds are told by as
well; of several labels of an id the greatest counts.  Scores
read whole texts.  Null and empty texts have no words, nothing that toxicity could
show in: their score is that of the bias, held below 0.5.  Null ids are scored like
others.  Without training rows every score is 0.  Equal texts get equal scores, rows
that repeat are kept row by row, and of equal windows in a text the first one learns.  A
very long text is read whole, in a slice of its own: some 100 bytes a word for each
filter width while it is in work.  Columns other than id, text and label are not
looked at, so their names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import language_id
from ._shared import byte_buffer, dropped, slices, span_hashes, text_or_empty, word_spans, written

BUCKETS, DIM, FILTERS = 1 << 18, 8, 6
WIDTHS = (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.08
#: Largest score of a text without words.
EMPTY_MOST = 0.49
#: Positive rows a language needs for a threshold of its own.
MIN_POSITIVE = 20
#: Logits in a block of running counts, on average.
BLOCK = 10_000


@dataclass
class ConvModel:
    embedding: np.ndarray
    kernels: list[np.ndarray]  # per width: [width, DIM, FILTERS]
    offsets: list[np.ndarray]
    weight: np.ndarray
    bias: float
    thresholds: dict[int, float] = field(default_factory=dict)  # by language, -1: all others


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, and the n+1 positions where texts begin."""
    starts, ends, rows = word_spans(data, offsets, language_id.LETTER)
    if not len(starts):
        return np.zeros(0, np.int64), rows
    return (span_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64), rows


def _windows(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the texts that have any, and where theirs begin."""
    count = np.maximum(np.diff(rows) - width + 1, 0)
    own = np.flatnonzero(count)
    begin = np.cumsum(count[own]) - count[own]
    first = np.repeat(rows[:-1][own] - begin, count[own]) + np.arange(int(count.sum()))
    return first, own, begin


def _maxima(model: ConvModel, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Max-pooled filter values [texts, widths * FILTERS]; 0 where no window fits."""
    out = np.zeros((len(rows) - 1, len(WIDTHS) * FILTERS), np.float32)
    for w, width in enumerate(WIDTHS):
        first, own, begin = _windows(rows, width)
        if not len(own):
            continue
        parts = [(model.embedding @ model.kernels[w][k])[words] for k in range(width)] if len(words) > BUCKETS else [model.embedding[words] @ model.kernels[w][k] for k in range(width)]
        value = parts[0][first]
        for k in range(1, width):
            value = value + parts[k][first + k]
        out[own, w * FILTERS : (w + 1) * FILTERS] = np.maximum(np.maximum.reduceat(value, begin, axis=0) + model.offsets[w], 0)
    return out


def logits(model: ConvModel, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return _maxima(model, words, rows) @ model.weight + model.bias


def fit(words: np.ndarray, rows: np.ndarray, label: np.ndarray, seed: int = 7) -> ConvModel:
    """Train on texts given as word buckets."""
    rng = np.random.default_rng(seed)
    n = len(label)
    text = np.repeat(np.arange(n), np.diff(rows))
    seen = np.unique(text * BUCKETS + words)
    seen_label = label[seen // BUCKETS]
    have = [np.bincount((seen % BUCKETS)[seen_label == y], minlength=BUCKETS) for y in (0, 1)]
    total = [max((label == y).sum(), 1) for y in (0, 1)]
    prior = total[1] / n
    odds = np.log((have[1] + 4 * prior) / (have[0] + 4 * (1 - prior)) * total[0] / total[1])
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -3, 3)
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0] += 0.5 / len(k)
    model = ConvModel(embedding, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32) + 0.2, -2.0)
    memory = {"e": np.full_like(embedding, 0.1), "w": np.full_like(model.weight, 0.1), "b": 0.1, "k": [np.full_like(k, 0.1) for k in kernels], "o": [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]}
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            part = np.sort(part)
            sizes = np.diff(rows)[part]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(rows[:-1][part] - bounds[:-1], sizes) + np.arange(bounds[-1])
            mine = words[at]
            pooled = np.zeros((len(part), len(WIDTHS) * FILTERS), np.float32)
            winner = []
            for w, width in enumerate(WIDTHS):
                first, own, begin = _windows(bounds, width)
                if not len(own):
                    winner.append(None)
                    continue
                e = model.embedding[mine]
                value = sum(e[first + k] @ model.kernels[w][k] for k in range(width))
                top = np.maximum.reduceat(value, begin, axis=0)
                of = np.searchsorted(begin, np.arange(len(first)), side="right") - 1
                is_top = value == top[of]
                place = np.full((len(own), FILTERS), -1)
                position, filt = np.nonzero(is_top)
                place[of[position][::-1], filt[::-1]] = first[position][::-1]  # the first of equals
                pooled[own, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top + model.offsets[w], 0)
                winner.append((own, place))
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.bias, -30, 30)))
            error = ((p - label[part]) / len(part)).astype(np.float32)
            up = error[:, None] * model.weight[None, :] * (pooled > 0)
            for name, gradient in (("w", pooled.T @ error + 1e-5 * model.weight), ("b", float(error.sum()))):
                memory[name] += gradient**2
                step = RATE * gradient / np.sqrt(memory[name])
                if name == "w":
                    model.weight -= step
                else:
                    model.bias -= step
            for w, width in enumerate(WIDTHS):
                if winner[w] is None:
                    continue
                own, place = winner[w]
                g = up[own, w * FILTERS : (w + 1) * FILTERS]
                for k in range(width):
                    at_words = mine[place + k]  # [texts, FILTERS]
                    vectors = model.embedding[at_words]
                    gk = np.einsum("tfd,tf->df", vectors, g)
                    flat = at_words.ravel()
                    ge = (g[:, :, None] * model.kernels[w][k].T[None]).reshape(-1, DIM)
                    hit, back = np.unique(flat, return_inverse=True)
                    total_e = np.zeros((len(hit), DIM), np.float32)
                    np.add.at(total_e, back, ge)
                    memory["k"][w][k] += gk**2
                    model.kernels[w][k] -= RATE * gk / np.sqrt(memory["k"][w][k])
                    memory["e"][hit] += total_e**2
                    model.embedding[hit] -= RATE * total_e / np.sqrt(memory["e"][hit])
                go = g.sum(axis=0)
                memory["o"][w] += go**2
                model.offsets[w] -= RATE * go / np.sqrt(memory["o"][w])
    return model


def best_threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """The logit above which F1 is best, halfway to the next lower one."""
    order = np.argsort(-logit, kind="stable")
    x, y = logit[order], label[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1  # a threshold can't part equals
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 0.5)


def _logits(docs: DataFrame, model: ConvModel, languages: language_id.LanguageModel, id_col: str, text_col: str) -> DataFrame:
    """id, logit and the language shown (-1: none) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, languages = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = byte_buffer(batch.column("text"))
                logit = logits(model, *word_buckets(data, offsets)).astype(float)
                lang = language_id.dominant_language(languages, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logit), pa.array(lang, pa.int32())], names=["id", "logit", "lang"])

    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_or_empty(text_col)).alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("logit", DoubleType()), StructField("lang", IntegerType())]))


def thresholds(rows: DataFrame) -> dict[int, float]:
    """best_threshold of all rows (label, logit, lang), under -1, and of each language that
    has enough; rows of the same logit are one, and running counts go by range blocks."""
    both = rows.select("label", "logit", F.explode(F.array_distinct(F.array(F.lit(-1), F.greatest("lang", F.lit(-1))))).alias("lang"))
    values = written(both.groupBy("lang", "logit").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("y")), "toxicity-logits")
    # Blocks of a language's logits, some thousand values each at most, by their rank's range.
    blocks = max(1, values.count() // BLOCK)
    low = values.groupBy("lang").agg(F.min("logit").alias("low"), F.max("logit").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / blocks, F.lit(1e-300))
    placed = values.join(F.broadcast(low), "lang").withColumn("block", F.floor((F.col("high") - F.col("logit")) / width)).drop("low", "high")
    sums = placed.groupBy("lang", "block").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    before = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("lang")
    heads = sums.select("lang", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("n", "y")], *[F.sum(c).over(total).alias(f"{c}_all") for c in ("n", "y")])
    mine = Window.partitionBy("lang", "block").orderBy(F.desc("logit"))
    upto = mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = placed.join(heads, ["lang", "block"]).select("lang", "logit", "block", "y_all", "n_all", (F.col("y_0") + F.sum("y").over(upto)).alias("hits"), (F.col("n_0") + F.sum("n").over(upto)).alias("taken"))
    told = told.withColumn("f1", 2 * F.col("hits") / (F.col("taken") + F.col("y_all")))
    best = told.groupBy("lang").agg(F.max(F.struct("f1", "logit")).alias("best"), F.first("n_all").alias("n"), F.first("y_all").alias("y"))
    best = best.select("lang", "best.logit", "n", "y")
    below = values.select("lang", F.col("logit").alias("next")).join(F.broadcast(best), "lang").filter(F.col("next") < F.col("logit")).groupBy("lang").agg(F.max("next").alias("next"))
    found = best.join(below, "lang", "left").collect()  # one row a language
    dropped(values)
    half = {r.lang: r.logit - 0.5 if r.next is None else (r.logit + r.next) / 2 for r in found if r.lang < 0 or MIN_POSITIVE <= r.y < r.n}
    return {int(k): float(v) for k, v in half.items()}


def train(docs: DataFrame, labels: DataFrame, usable: Column, languages: language_id.LanguageModel, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = 12_000) -> ConvModel | None:
    """Fit on labelled rows where `usable` holds; all that the fit has not seen, a fifth or
    more, calibrate thresholds."""
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    draw = F.pmod(F.xxhash64(F.lit("tox"), F.col(id_col)), F.lit(1 << 30))
    chosen = marked.filter(usable)
    n = chosen.count()
    share = int(max_train_docs / n * (1 << 30)) if n > max_train_docs else 1 << 30
    learns = (draw < share) & (draw % 5 != 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, at = word_buckets(*byte_buffer(batch.column("text")))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words, pa.int32())), batch.column("label")], names=["words", "label"])

    def fitted(which: Column) -> ConvModel | None:
        # At most max_train_docs rows (a hash's share of them), as numbers; their ids go to the texts.
        few = F.broadcast(chosen.filter(which))
        rows = docs.filter(which).select(id_col, F.lower(text_or_empty(text_col)).alias("text")).join(few, id_col)
        got = rows.select("text", "label").mapInArrow(hashed, "words array<int>, label int").toArrow().combine_chunks()
        label = np.array(got.column("label").to_pylist())
        if not len(label) or label.min() == label.max():
            return None
        lists = got.column("words").combine_chunks() if isinstance(got.column("words"), pa.ChunkedArray) else got.column("words")
        return fit(np.array(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.array(lists.value_lengths()))]), label)

    ids = docs.select(id_col).join(chosen, id_col).groupBy(learns.alias("learns"), "label")
    kinds = {(r.learns, r.label): r["count"] for r in ids.count().collect()}
    parted = min(kinds.get((which, 1), 0) for which in (True, False)) >= 2
    model = fitted(learns if parted or n > max_train_docs else F.lit(True))
    if model is None:
        return None
    # Texts stay where they are: their logits meet the labels.
    held = docs.filter(F.col(id_col).isNotNull() & (~learns if parted else F.lit(True)))
    told = _logits(held, model, languages, id_col, text_col).join(chosen.withColumnRenamed(id_col, "id"), "id")
    model.thresholds = thresholds(told.select("label", "logit", "lang"))
    return model


def score(docs: DataFrame, model: ConvModel | None, languages: language_id.LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1; 0.5 is the threshold of the text's language)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, languages = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                if model is None:
                    got = np.zeros(batch.num_rows)
                else:
                    data, offsets = byte_buffer(batch.column("text"))
                    words, at = word_buckets(data, offsets)
                    logit = logits(model, words, at)
                    lang = language_id.dominant_language(languages, data, offsets)
                    cut = np.array([model.thresholds.get(int(k), model.thresholds[-1]) for k in lang])
                    got = 1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))
                    got = np.where(np.diff(at) > 0, got, np.minimum(got, EMPTY_MOST))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got.astype(float))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_or_empty(text_col)).alias("text")).mapInArrow(run, "id long, score double")
