"""Language identification as inference of a multilingual mixture.

A word's likelihood in a language is the product of the likelihoods of its
byte trigrams (word borders included).  A document is a mixture: expectation
maximisation over its words estimates each language's share.  The language set
is selected by penalised likelihood: starting from all languages, the one with
the smallest share leaves as long as that does not cost more log-likelihood
than its parameter is worth (half the log of the number of words).

Training counts come from at most `max_train_docs` documents of known language
(all, if there are fewer), chosen by a hash of their id; the table has a fixed
number of buckets per language.  Prediction reads whole texts and nothing else.

Null text, or text without a letter: language `und`, score 0, no shares.  Null
ids are kept.  Without any training row every document is `und`, and an empty
table gives an empty result.  Equal texts get equal shares, rows that repeat are
kept row by row, and of languages with equal shares the first by name is the main
one.  A very long text is read whole, in a slice of its own: some 20 bytes a byte of
text and language while it is in work.  Other columns travel in the struct
`carry`, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import byte_buffer, slices, text_or_empty, word_spans

BUCKETS = 1 << 16
#: Letters are a-z and every byte of a multi-byte character; texts come lower-cased.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True
#: Per word and round; shares settle long before.
EM_ROUNDS, SET_ROUNDS = 8, 4
#: In each round of set selection, a removal is refitted with fewer rounds.
MIN_SHARE = 1e-6


@dataclass
class LanguageModel:
    """languages: names; logp: float32[len(languages), BUCKETS]."""

    languages: list[str]
    logp: np.ndarray


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the bucket of the trigram centred on it; bytes that are no
    letters, and row borders, count as a blank."""
    n = len(data)
    x = np.where(LETTER[data], data, 32).astype(np.uint32)
    left = np.empty(n, np.uint32)
    left[0] = 32
    left[1:] = x[:-1]
    right = np.empty(n, np.uint32)
    right[-1] = 32
    right[:-1] = x[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    left[cut] = 32
    right[cut[1:] - 1] = 32
    code = (left << np.uint32(16)) | (x << np.uint32(8)) | right
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(16)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = byte_buffer(batch.column("text"))
            if not len(data):
                continue
            codes, letter = trigram_codes(data, offsets), LETTER[data]
            langs = np.array(batch.column("lang").to_pylist(), object)
            lengths = np.diff(offsets)
            for lang in set(langs.tolist()):
                of = np.repeat(langs == lang, lengths) & letter
                got = np.bincount(codes[of], minlength=BUCKETS)
                total[lang] = total[lang] + got if lang in total else got
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = 20_000) -> LanguageModel:
    """Fit on the rows where `usable` holds and the language is known."""
    known = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    if n > max_train_docs:
        share = int(max_train_docs / n * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64(F.lit("lid"), F.col(id_col)), F.lit(1 << 30)) < share)
    rows = (
        known.select(F.lower(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names, bucket, count = (rows.column(c).to_pylist() for c in ("lang", "bucket", "n"))
    languages = sorted(set(names))
    table = np.full((len(languages), BUCKETS), 0.02)
    index = {x: i for i, x in enumerate(languages)}
    for lang, b, c in zip(names, bucket, count, strict=True):
        table[index[lang], b] += c
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if languages else np.zeros((0, BUCKETS), np.float32))


def word_scores(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods float32[languages, words] and the n+1 word positions of the rows."""
    starts, ends, rows = word_spans(data, offsets, LETTER)
    if not len(starts):
        return np.zeros((len(model.languages), 0), np.float32), rows
    codes = trigram_codes(data, offsets)
    letters = np.flatnonzero(LETTER[data])
    codes = codes[letters]
    first = np.searchsorted(letters, starts)
    return np.stack([np.add.reduceat(p[codes], first) for p in model.logp]), rows


def _sums(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the last axis by row; rows without words give 0."""
    total = np.zeros(x.shape[:-1] + (x.shape[-1] + 1,), np.float64)
    np.cumsum(x, axis=-1, out=total[..., 1:], dtype=np.float64)
    return total[..., rows[1:]] - total[..., rows[:-1]]


def _fit(p: np.ndarray, rows: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation: shares [L, docs] and log-likelihood [docs], which
    leaves out each word's largest term.  p: word likelihoods relative to that."""
    words = np.diff(rows)
    of = np.repeat(np.arange(len(words)), words)
    share = share.astype(np.float32)
    for _ in range(rounds):
        joint = p * share[:, of]
        total = np.maximum(joint.sum(axis=0), np.float32(1e-30))
        share = (_sums(joint / total, rows) / np.maximum(words, 1)).astype(np.float32)
    total = np.maximum((p * share[:, of]).sum(axis=0), np.float32(1e-30))
    return share, _sums(np.log(total), rows)


def _pick(p: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents only."""
    sizes = np.diff(rows)
    keep = np.zeros(len(sizes), bool)
    keep[docs] = True
    return p[:, np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[docs])])


def infer_shares(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares [languages, rows] of the selected set; all 0 for rows without words."""
    scores, rows = word_scores(model, data, offsets)
    n, langs = len(rows) - 1, len(model.languages)
    if not scores.shape[1] or not langs:
        return np.zeros((langs, n))
    top = scores.max(axis=0)
    p = np.exp(np.maximum(scores - top, np.float32(-60)))
    words = np.diff(rows)
    penalty = 0.5 * np.log(np.maximum(words, 2))
    share, fit = _fit(p, rows, np.full((langs, n), 1 / langs), EM_ROUNDS)
    # One language alone beats every mixture that can at best fit as well as all of them.
    alone = _sums(np.log(np.maximum(p, np.float32(1e-30))), rows)
    best = alone.argmax(axis=0)
    sure = alone[best, np.arange(n)] >= fit - penalty
    share[:, sure] = 0
    share[best[sure], np.flatnonzero(sure)] = 1
    open_docs = np.flatnonzero(~sure & (words > 0))
    for _ in range(langs - 1):
        if not len(open_docs):
            break
        mine = share[:, open_docs].copy()
        active = mine > MIN_SHARE
        mine[~active] = 0
        several = active.sum(axis=0) > 1
        open_docs, mine, active = open_docs[several], mine[:, several], active[:, several]
        if not len(open_docs):
            break
        least = np.where(active, mine, 2).argmin(axis=0)
        trial = mine
        trial[least, np.arange(len(open_docs))] = 0
        trial /= trial.sum(axis=0)
        sub, sub_rows = _pick(p, rows, open_docs)
        trial, new_fit = _fit(sub, sub_rows, trial, SET_ROUNDS)
        better = new_fit >= fit[open_docs] - penalty[open_docs]
        chosen = open_docs[better]
        share[:, chosen], fit[chosen] = trial[:, better], new_fit[better]
        open_docs = chosen
    share[:, words == 0] = 0
    return np.where(share > MIN_SHARE, share, 0)


def dominant_language(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the language that explains most words best; -1 without words."""
    scores, rows = word_scores(model, data, offsets)
    if not scores.shape[1] or not len(scores):
        return np.full(len(rows) - 1, -1)
    won = scores.argmax(axis=0)
    votes = np.stack([_sums((won == k).astype(np.float32), rows) for k in range(len(scores))])
    return np.where(votes.sum(axis=0) > 0, votes.argmax(axis=0), -1)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """lang_pred, score (the share of lang_pred), shares (a map of the selected
    set), and the struct `carry` of the columns asked for, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed buckets x languages
    rows = docs.select(F.lower(text_or_empty(text_col)).alias("text"), text_or_empty(text_col).rlike(r"\p{L}").alias("letters"), F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("carry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for whole in batches:
            for batch in slices(whole, "text"):
                share = infer_shares(model, *byte_buffer(batch.column("text")))
                share = np.concatenate([share, np.zeros((1, batch.num_rows))])
                share[:, ~np.array(batch.column("letters").to_pylist(), bool)] = 0
                best, score = share.argmax(axis=0), share.max(axis=0)
                best[score == 0] = len(names) - 1
                row, lang = np.nonzero(share.T)
                maps = pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(names[lang], pa.string()), pa.array(share.T[row, lang].astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(float)), maps, batch.column("carry")], names=["lang_pred", "score", "shares", "carry"])

    return rows.mapInArrow(run, StructType.fromDDL("lang_pred string, score double, shares map<string,double>").add("carry", rows.schema["carry"].dataType))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """Drop what has no language (`und`) or no language with a share of min_score."""
    found = identify(docs, model, text_col)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("carry.*")
