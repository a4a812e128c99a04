"""Near-duplicate join: pairs of documents whose word n-gram sets have a Jaccard
similarity of at least `threshold`, by a MinHash LSH forest.

1. Documents with the same word sequence form a class; one representative goes
   on.  (A map-side combined aggregate: a text that fills a third of the table
   is one row per task.)
2. A representative's n-grams give a signature of trees x depth minimum hashes.
   In each tree the signature is a path of `depth` values, a leaf of a prefix
   trie; a subtrie is the leaves of one prefix, dealt and sorted together.
3. Documents that share a prefix at full depth meet first.  Matched prefixes
   are then shortened, in the nodes alone that fork below, until a pair at the
   threshold shares one in some tree with the target recall, whatever else was
   found.  A pair that met at the longer prefix or in an earlier tree is not
   compared again, so it counts once.
4. Subtries of more than `block` members or BLOCK_BYTES of words are cut into
   blocks that meet pairwise.  Members that meet nobody for the first time leave;
   the others bring their words and are verified exactly by their n-gram sets,
   all against all within a block pair by a matrix product, without ever making
   rows of pairs.
5. What comes out is linear: per member its number of linked documents and the
   smallest member of its connected part.  Parts are joined over subtries by
   alternating star contraction with checkpoints in the shared folder.

Words are what white space separates, lower-cased, without punctuation at the
ends.  A text of fewer words than n has one n-gram, the text; a text without
words (null, empty) is in no pair and a class of its own.  Null ids take part
like others, and lose as smallest id.  Rows that repeat an id count as rows.  Of
classes with the same smallest id the one of the smaller number stays.  A very
long text is in a block by itself, whole.  Other columns are looked at only by
keep_one_per_group, which carries them in a struct, so their names can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import byte_buffer, mix64, slices, span_hashes, text_or_empty, word_spans, written

TREES, DEPTH = 24, 8
#: Bytes of a value in a path (a multiple of these makes two 64-bit words a path).
VALUE = 2
#: Bytes of words that a block has on average at most.
BLOCK_BYTES = 4 << 20
#: Largest id, which stands for null.
NO_ID = (1 << 63) - 1
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
#: Punctuation that doesn't belong to a word.
WORD[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = False


def forest_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is met with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each row, and the positions of rows."""
    starts, ends, rows = word_spans(data, offsets, WORD)
    words = np.diff(rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = span_hashes(data, starts, ends)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(words)), count)
    first = rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    gram = np.zeros(len(row), np.uint64)
    for k in range(n):
        at = np.minimum(first + k, len(h) - 1)
        inside = first + k < rows[1:][row]
        gram = np.where(inside, mix64(gram * np.uint64(0x9E3779B97F4A7C15) + h[at] + np.uint64(k + 1)), gram)
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, np.searchsorted(row, np.arange(len(words) + 1))


_multipliers = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_addends = mix64(np.arange(1 << 20, (1 << 20) + TREES * DEPTH, dtype=np.uint64)).astype(np.uint32)


def signatures(gram: np.ndarray, rows: np.ndarray, many: int) -> np.ndarray:
    """uint32[rows, many] minimum hashes; rows without n-grams get 0."""
    out = np.zeros((len(rows) - 1, many), np.uint32)
    full = np.flatnonzero(np.diff(rows) > 0)
    # Two n-gram hashes of 32 bits each: the second is mixed in after the multiplication.
    low = (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (gram >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(full), 256):
        part = full[first : first + 256]
        a, b = rows[part[0]], rows[part[-1] + 1]
        at = rows[part] - a
        x, y = low[a:b], high[a:b]
        for k in range(many):
            z = x * _multipliers[k] + _addends[k]
            z ^= z >> np.uint32(15)
            z += y
            z *= _multipliers[many - 1 - k]
            out[part, k] = np.minimum.reduceat(z, at)
    return out


def trie_paths(signature: np.ndarray) -> pa.Array:
    """Per row the paths of all trees, one after the other, as bytes that sort as the
    values do."""
    raw = (signature >> np.uint32(16)).astype(">u2").tobytes()
    size = TREES * DEPTH * VALUE
    ends = pa.array(np.arange(0, (len(signature) + 1) * size, size), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(signature), [None, ends.buffers()[1], pa.py_buffer(raw)])


def prefix_labels(paths: pa.Array, depth: int) -> np.ndarray:
    """uint64[rows, TREES]: a hash of each tree's path down to depth."""
    raw, _ = byte_buffer(paths)
    words = raw.reshape(-1, TREES, DEPTH * VALUE).view(">u8").astype(np.uint64)
    bits = 8 * VALUE * depth
    if bits < 128:
        words[..., 1] = words[..., 1] >> np.uint64(128 - bits) if bits > 64 else 0
    if bits < 64:
        words[..., 0] >>= np.uint64(64 - bits)
    return mix64(words[..., 0] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[..., 1]))


# ---------------------------------------------------------------- representatives


def word_classes(docs: DataFrame, id_col: str, text_col: str, more: list[Column] = []) -> DataFrame:
    """id, key, words and more per row; the key is a digest of the word sequence,
    null without words."""
    words = F.trim(F.regexp_replace(F.lower(text_or_empty(text_col)), r"[\x09-\x0D\x20!-/:-@\[-`{-~]+", " "))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), words.alias("words"), *more).withColumn("key", F.when(F.col("words") != "", F.unhex(F.md5("words"))))


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "words"):
                data, offsets = byte_buffer(batch.column("words"))
                paths = trie_paths(signatures(*shingles(data, offsets, n), TREES * DEPTH))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), paths, pa.array(np.diff(offsets))], names=["rep", "paths", "bytes"])

    return run


# ---------------------------------------------------------------- within a bucket


class _Paths:
    """Whether two members meet here for the first time."""

    def __init__(self, paths: pa.Array, depth: int, longer: int | None):
        self.labels = prefix_labels(paths, depth)
        self.longer = prefix_labels(paths, longer) if longer else None

    def met_here(self, a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
        """bool[a, b]: no earlier tree, nor a longer prefix in any, brings them together."""
        first = np.ones((len(a), len(b)), bool)
        for t in range(tree):
            first &= self.labels[a, t, None] != self.labels[None, b, t]
        if self.longer is not None:
            for t in range(TREES):
                first &= self.longer[a, t, None] != self.longer[None, b, t]
        return first


class _Sets:
    """N-gram sets as rows of a 0/1 matrix, in strips of columns."""

    def __init__(self, gram: np.ndarray, rows: np.ndarray):
        self.size = np.diff(rows)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        values, self.column = np.unique(gram, return_inverse=True)
        order = np.argsort(self.column, kind="stable")
        self.row, self.column = self.row[order], self.column[order]
        # An n-gram that one set alone has adds nothing to an intersection.
        often = np.bincount(self.column, minlength=len(values)) > 1
        keep = often[self.column]
        self.row, self.column = self.row[keep], (np.cumsum(often) - 1)[self.column[keep]]
        self.n = int(often.sum())

    def common(self, strip: int = 4096) -> np.ndarray:
        total = np.zeros((len(self.size), len(self.size)), np.float32)
        for first in range(0, self.n, strip):
            a, b = np.searchsorted(self.column, [first, first + strip])
            block = np.zeros((len(self.size), min(strip, self.n - first)), np.float32)
            block[self.row[a:b], self.column[a:b] - first] = 1
            total += block @ block.T
        return total


def _roots(link: np.ndarray) -> np.ndarray:
    """For a symmetric bool matrix, the smallest index of each one's connected part."""
    root = np.arange(len(link))
    while True:
        best = np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Groups of a sorted stream, one at a time, as columns of Python/numpy values."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        marks = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(marks, marks[1:]):
            key = tuple(c[a] for c in cols)
            if key != current and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


BUCKET = ["tree", "label", "one", "two"]


def _candidates(depth: int, longer: int | None):
    """Of each block pair, the members that some pair met here may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches, BUCKET):
            tree, one, two = (int(group.column(c)[0].as_py()) for c in ("tree", "one", "two"))
            side = group.column("block").to_numpy()
            a, b = np.flatnonzero(side == one), np.flatnonzero(side == two)
            want = _Paths(group.column("paths"), depth, longer).met_here(a, b, tree)
            if one == two:
                np.fill_diagonal(want, False)
            keep = np.union1d(a[want.any(axis=1)], b[want.any(axis=0)])
            if len(keep):
                yield group.take(pa.array(keep)).select(["rep", *BUCKET, "block", "paths"])

    return run


def _verify(n: int, threshold: float, depth: int, longer: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches, BUCKET):
            tree, one, two = (int(group.column(c)[0].as_py()) for c in ("tree", "one", "two"))
            side, rep, copies = (group.column(c).to_numpy() for c in ("block", "rep", "copies"))
            sets = _Sets(*shingles(*byte_buffer(group.column("words")), n))
            common = sets.common()
            union = sets.size[:, None] + sets.size[None, :] - common
            every = np.arange(len(rep))
            link = (common >= threshold * union - 1e-6) & _Paths(group.column("paths"), depth, longer).met_here(every, every, tree)
            link &= ((side[:, None] == one) & (side[None, :] == two)) | ((side[:, None] == two) & (side[None, :] == one))
            np.fill_diagonal(link, False)
            linked = np.flatnonzero(link.any(axis=1))
            if len(linked):
                order = np.argsort(rep, kind="stable")
                root = np.empty(len(rep), np.int64)
                root[order] = rep[order][_roots(link[np.ix_(order, order)])]
                lowest = np.where(link, common / union, 1.0).min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[linked]), pa.array(root[linked]), pa.array((link @ copies)[linked].astype(np.int64)), pa.array(link.sum(axis=1)[linked].astype(np.int64)), pa.array(lowest[linked], pa.float64())],
                    names=["rep", "root", "links", "texts", "lowest"],
                )

    return run


# ---------------------------------------------------------------- connected parts


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each one's connected part, for edges
    (a, b), by alternating large and small stars.  Each round's edges are written
    to the shared folder; their number never exceeds that of the input."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if small:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        else:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = written(star(star(now, False), True), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)


# ---------------------------------------------------------------- the operator


def links_at(classes: DataFrame, sketches: DataFrame, depth: int, longer: int | None, n: int, threshold: float, block: int) -> DataFrame:
    """The links of pairs that share a prefix of `depth` values in some tree and none
    of `longer` values in any: per member and block pair rep, root, links, texts and
    the lowest similarity."""
    size = DEPTH * VALUE
    trees = F.array(*[F.substring("paths", t * size + 1, size) for t in range(TREES)])
    entry = sketches.select("rep", "bytes", F.posexplode(trees).alias("tree", "path")).withColumn("label", F.xxhash64(F.substring("path", 1, depth * VALUE)))
    node = entry.withColumn("inner", F.xxhash64(F.substring("path", 1, (longer or depth) * VALUE)))
    forks = node.groupBy("tree", "label").agg(F.count("*").alias("size"), F.sum("bytes").alias("all_bytes"), (F.min("inner") != F.max("inner")).alias("forks")).filter("size > 1" + " and forks" * bool(longer))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    placed = entry.join(forks, ["tree", "label"]).select("rep", "tree", "label", blocks.alias("blocks"), mine.alias("block"))
    paired = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "tree", "label", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block")
    paired = written(paired, "near-subtries", "snappy").join(sketches.select("rep", "paths"), "rep")
    subtries = paired.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "rep")
    wanted = written(subtries.mapInArrow(_candidates(depth, longer), "rep long, tree int, label long, one int, two int, block int, paths binary"), "near-candidates")
    brought = wanted.join(classes.select("rep", "copies", "words"), "rep")
    made = brought.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "rep").mapInArrow(_verify(n, threshold, depth, longer), "rep long, root long, links long, texts long, lowest double")
    return written(made, "near-links")


def forest_links(classes: DataFrame, sketches: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, list[int]]:
    """All links, and the prefix lengths at which documents met, longest first."""
    depths = [DEPTH]
    found = links_at(classes, sketches, DEPTH, None, n, threshold, block)
    depth = forest_depth(threshold, recall)
    if depth < DEPTH:
        found = found.unionByName(links_at(classes, sketches, depth, DEPTH, n, threshold, block))
        depths.append(depth)
    return found, depths


def near_classes(rows: DataFrame, n: int, threshold: float, recall: float, block: int) -> DataFrame:
    """One row per class of equal word sequences in rows (id, key, words): key;
    first (its smallest id); copies; links (rows of other classes linked to it);
    texts (those classes); group_id (smallest id of its connected part); keep
    (whether it is the class that stays of that part)."""
    # The words ride on the aggregate as one text per class and task.  Classes are
    # numbered, as an id may stand for rows of different texts.
    made = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("words").alias("words"))
    classes = written(made.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    sketches = written(classes.select("rep", "words").mapInArrow(_sketches(n), "rep long, paths binary, bytes long"), "near-sketches")
    found, _ = forest_links(classes, sketches, n, threshold, recall, block)
    parts = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = classes.select("rep", "first").join(links, "rep").join(parts, F.col("rep") == F.col("node"), "left").select("rep", "first", "links", "texts", F.coalesce("root", "rep").alias("root"))
    tops = linked.groupBy("root").agg(F.min(F.struct("first", "rep")).alias("top"))
    grouped = linked.join(tops, "root").select("rep", "links", "texts", "top")
    none = F.lit(0).cast("long")
    return classes.select("key", "first", "copies", "rep").join(grouped, "rep", "left").select(
        "key",
        "first",
        "copies",
        F.coalesce("links", none).alias("links"),
        F.coalesce("texts", none).alias("texts"),
        F.coalesce("top.first", "first").alias("group_id"),
        F.coalesce(F.col("top.rep") == F.col("rep"), F.lit(True)).alias("keep"),
    )


def near_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id; class_id (smallest id with these words); copies
    (rows in the class); n_links (rows of other classes linked to it, plus the
    other rows of its own); n_linked_texts (those classes); group_id (smallest
    id of its connected part)."""
    rows = word_classes(docs, id_col, text_col)
    classes = near_classes(rows, n, threshold, recall, block)
    given = lambda c: F.when(c != NO_ID, c)
    return rows.select("id", "key").join(classes, "key", "left").select(
        given(F.col("id")).alias("id"),
        given(F.coalesce("first", "id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        given(F.coalesce("group_id", "id")).alias("group_id"),
    )


def keep_one_per_group(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each connected group one row of the smallest
    id stays, and every row without words; same columns."""
    rows = word_classes(docs, id_col, text_col)
    stays = near_classes(rows, n, threshold, recall, block).filter("keep").select("key", F.col("first").alias("id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = word_classes(docs, id_col, text_col, [row]).drop("words")
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.xxhash64(F.col(f"row.`{text_col}`"))))
    kept = mine.filter("key is not null").join(stays, ["key", "id"], "left_semi").withColumn("nth", nth).filter("nth = 1")
    return mine.filter("key is null").select("row.*").unionByName(kept.select("row.*"))
