"""Periodic runs: maximal stretches of words that repeat with a smallest period.

All texts of a slice of a batch are one array of word numbers; a text's words
rank apart from other texts' and its end is a mark of its own, so that nothing
reaches over it.  The method, with every step over the whole slice in numpy:

1. Prefix doubling sorts all suffixes.  Its ranks at length 1, 2, 4, ... are
   kept: two places have equal ranks at a level exactly where that many words are
   equal, which extends matches forwards and backwards in as many steps as levels.
2. Neighbours in the suffix array give the LCP array.  Pointer jumping to the
   previous and next suffix of a smaller place, with the least LCP on the way,
   gives the longest previous factor of each place, and these the LZ blocks.
3. At each border of blocks s, t (Main) every period q up to |s| + |t| is tried
   on both sides of the border: the places (i, i + q) with i or i + q at the border
   are extended to the left and the right; a run covers them if the extensions
   add up to q.  The tries are 4 per word at most.  This finds every run that
   touches a border: let block [b, e) hold its last word.  If b is before the end
   of the run's first period the run has a period to the right of b, of at most
   e - b words.  If b is later, the block before can't begin a period after the
   run's start (it would have gone on to the run's end), so that q is less than
   both blocks' lengths together.
4. Other runs lie inside a block and are copies of runs at the place that the
   block was copied from; runs are held in buckets by their start, and blocks copy
   from left to right.

A run that also repeats with a multiple of its period is found with both; the
least period of a stretch counts.  No hash decides: word numbers and ranks are
exact.  Null and empty texts have no words, and a null id leaves a text as it
is in the contract's made-up repeats.  Null and repeated ids and equal rows are
kept row by row.  Ties among longest runs go to the smallest start, then period.
A very long text is a slice of its own: some 100 bytes a word while it is in work.
Columns other than id and text are not looked at, so their names can't clash.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import slices, text_or_empty

#: Runs of fewer words are not reported.
MIN_WORDS = 12

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, lengths, periods


def doubling_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of length 1, 2, 4, ... at each place, to the level
    at which all differ.  A substring's rank is the number of suffixes that sort
    before all suffixes with its beginning."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    key = first[order]
    levels, open_, width = [], order, 1
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, sizes)
    levels.append(rank.astype(np.int32))
    open_ = order[np.repeat(sizes, sizes) > 1]
    while len(open_):
        then = open_ + width
        second = np.where(then < n, rank[np.minimum(then, n - 1)], -1)
        key = rank[open_] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = rank[open_]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(new_group, at, 0))
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(open_)))
        rank[open_] = group + np.repeat(head, sizes) - begin
        levels.append(rank.astype(np.int32))
        open_ = open_[np.repeat(sizes, sizes) > 1]
        width *= 2
    return levels


def extend_right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i != j)."""
    n = len(levels[0])
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero((i < n) & (j < n))
    live = live[levels[0][i[live]] == levels[0][j[live]]]
    for k in range(len(levels) - 1, -1, -1):
        a, b = i[live] + out[live], j[live] + out[live]
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        out[live[same & (a < n) & (b < n)]] += 1 << k
    return out


def extend_left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words up to and with i equal those up to and with j (i != j)."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero((i >= 0) & (j >= 0))
    live = live[levels[0][i[live]] == levels[0][j[live]]]
    for k in range(len(levels) - 1, -1, -1):
        a, b = i[live] - out[live] - (1 << k) + 1, j[live] - out[live] - (1 << k) + 1
        same = levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)]
        out[live[same & (a >= 0) & (b >= 0)]] += 1 << k
    return out


def longest_previous(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each place, and where it is found (-1: nowhere)."""
    rank = levels[-1].astype(np.int64)
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = extend_right(levels, suffix[:-1], suffix[1:])
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for backwards in (False, True):
        place = suffix[::-1] if backwards else suffix
        low = np.concatenate([[0], lcp[:0:-1]]) if backwards else lcp.copy()
        to = np.arange(n) - 1  # all between have a later place than both ends look for
        live = np.arange(1, n)
        while len(live):
            live = live[(to[live] >= 0) & (low[live] > 0)]
            live = live[place[to[live]] > place[live]]
            via = to[live]
            low[live], to[live] = np.minimum(low[live], low[via]), to[via]
        low[to < 0] = 0
        better = low > best[place]
        best[place[better]], source[place[better]] = low[better], place[to[better]]
    return best, source


def lz_blocks(longest: np.ndarray) -> np.ndarray:
    """Where the blocks begin: each is its place's longest previous factor, or one word."""
    following = (np.arange(len(longest)) + np.maximum(longest, 1)).tolist()
    found, at, n = [], 0, len(longest)
    while at < n:
        found.append(at)
        at = following[at]
    return np.array(found, np.int64)


def border_runs(levels: list[np.ndarray], border: np.ndarray, most: int, step: int = 1 << 20) -> Runs:
    """Runs found from the borders of blocks (borders with both ends; `most` words)."""
    size = np.diff(border, prepend=border[:1], append=border[-1:])
    tries = size[:-1] + size[1:]
    found = []
    total = np.cumsum(tries)
    lo = 0
    while lo < len(border):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step, side="right")))
        n = tries[lo:hi]
        at = np.repeat(border[lo:hi], n)
        period = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        i = np.concatenate([at, at - period])
        period = np.concatenate([period, period])
        fits = (i >= 0) & (i + period <= most)
        i, period = i[fits], period[fits]
        lo = hi
        # A run needs a period's worth of equal words: most tries have none.
        one = levels[0]
        right = (i + period < most) & (one[np.minimum(i, most - 1)] == one[np.minimum(i + period, most - 1)])
        left = (i > 0) & (one[i - 1] == one[i + period - 1])
        near = right | left
        i, period = i[near], period[near]
        back = extend_left(levels, i - 1, i + period - 1)
        ahead = extend_right(levels, i, i + period)
        run = (back + ahead >= period) & (back + ahead + period >= MIN_WORDS)
        found.append(np.stack([i[run] - back[run], (back + ahead + period)[run], period[run]]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return start, length, period


def _copied(runs: dict[int, dict[int, int]], blocks: list[tuple[int, int, int]]) -> None:
    """Copy the runs strictly inside each block (start, length, source) from its source."""
    for begin, length, source in blocks:
        shift = begin - source
        for start in range(source + 1, source + length - MIN_WORDS):
            for end, period in list(runs.get(start, {}).items()):
                if end < source + length:
                    runs.setdefault(start + shift, {}).setdefault(end + shift, period)


def all_runs(words: np.ndarray, rows: np.ndarray) -> tuple[Runs, np.ndarray]:
    """Every run of each text, sorted by text, start, period, and the n+1 positions
    where texts begin in them.  `words` are numbers below 2^31, `rows` the n+1
    positions where texts begin; starts count from the text's first word."""
    n = len(rows) - 1
    sizes = np.diff(rows)
    text = np.repeat(np.arange(n), sizes + 1)
    ends = rows[1:] + np.arange(n)  # the marks' places
    first = text << np.int64(32)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    first[inside] += words.astype(np.int64) + 1
    begin = rows[:-1] + np.arange(n)
    none = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return none, np.zeros(n + 1, np.int64)
    levels = doubling_ranks(first)
    longest, source = longest_previous(levels)
    block = lz_blocks(longest)  # a mark is a block of its own
    start, length, period = border_runs(levels, np.append(block, len(text)), len(text))
    if not len(start):
        return none, np.zeros(n + 1, np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[least], length[least], period[least]
    long = longest[block] > MIN_WORDS + 1
    with_runs = np.unique(text[start])
    where = block[long]
    where = where[np.isin(text[where], with_runs)]
    if len(where):
        held: dict[int, dict[int, int]] = {}
        for s, k, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
            held.setdefault(s, {})[s + k] = q
        _copied(held, list(zip(where.tolist(), longest[where].tolist(), source[where].tolist(), strict=True)))
        start, length, period = np.array([(s, e - s, q) for s, found in held.items() for e, q in found.items()], np.int64).T
    order = np.lexsort((length, period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start]
    return (start - begin[of], length, period), np.searchsorted(of, np.arange(n + 1))


def repeated(words: np.ndarray, doc: int | None) -> np.ndarray:
    """The contract's made-up repeats: a tenth of the texts go on with a period."""
    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at < a, at, a + (at - a) % p)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[np.ndarray, int | None], np.ndarray] | None = None, with_runs: bool = False) -> DataFrame:
    """One row per document: id, n_runs, the longest run (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256; with `with_runs` also the
    runs and the collapsed text.  `change` edits a text's words before the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("id").to_pylist()
                split = [raw.split() for raw in batch.column("text").cast(pa.binary()).to_pylist()]
                rows = np.zeros(len(split) + 1, np.int64)
                np.cumsum([len(s) for s in split], out=rows[1:])
                flat = [w for s in split for w in s]
                words = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                if change is not None:
                    places = np.arange(len(words))
                    for k, doc in enumerate(ids):
                        mine = places[rows[k] : rows[k + 1]]
                        edited = change(mine, doc)
                        if edited is not mine:
                            split[k] = [flat[x] for x in edited.tolist()]
                            places[rows[k] : rows[k + 1]] = edited
                    words = words[places]
                (start, length, period), at = all_runs(words, rows)
                out = [_facts(split[k], start[at[k] : at[k + 1]], length[at[k] : at[k + 1]], period[at[k] : at[k + 1]], with_runs) for k in range(len(ids))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([run_type, pa.string()] if with_runs else [])
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * with_runs
    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * with_runs)


def _facts(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray, with_runs: bool) -> tuple:
    found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    if found:
        # A word goes if some run holds it after that run's first period.
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    kept = b" ".join(words)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    facts = (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (*facts, [dict(start=s, length=k, period=q) for s, k, q in found], kept.decode()) if with_runs else facts
