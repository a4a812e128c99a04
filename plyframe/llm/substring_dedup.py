"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; where the bits that depend on the
last 16 bytes meet the condition, a chunk ends.  A boundary directly after
another (within MIN_CHUNK bytes) does not count, whether or not that one did:
so boundaries depend on nothing but the bytes just before them, and an
insertion shifts chunks without changing those that follow.  Stretches without
a boundary, as in periodic text, are cut at the smallest hash 32 to 64 bytes
after the last cut, which falls into step with the period.  A boundary inside a
character moves to the character's end.  Chunks are
deduplicated by 128-bit digests over all documents, and so are pairs of
neighbouring chunks: repeated chunks make a passage where their pairs are repeated as
well (chunks that happen to be elsewhere one by one do not).  Passages are reported
from a given number of words on, in parts by the document that has them first.

Null or empty text has no chunks.  Null ids are one document, smaller than any
other; rows that repeat an id are one document.  A very long text is chunked whole
in the task that has it.  Only cut_repeats looks at other columns, and carries them
in a struct, so their names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import byte_buffer, mix64, slices, text_or_empty
from ._sorted_runs import repeated

#: Mean distance of candidate boundaries is 2 ** BITS bytes; the bits tested end
#: below bit 16, which the gear hash takes from the last 16 bytes.
BITS, TOP_BIT = 5, 16
MIN_CHUNK = 12
LONG_CHUNK = 96
NO_ID = -(1 << 63)
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 16, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
    return h


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each chunk; every row's bytes are covered in order."""
    lengths = np.diff(offsets)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    test = np.uint32(((1 << BITS) - 1) << (TOP_BIT - BITS))
    gear = gear_hashes(data)
    cut = np.flatnonzero((gear & test) == 0) + 1  # ends of chunks
    row = np.searchsorted(offsets, cut, side="left") - 1
    # The first 15 bytes of a row would hash bytes of the row before.
    own = cut - offsets[row] >= TOP_BIT
    cut, row = cut[own], row[own]
    apart = np.ones(len(cut), bool)
    apart[1:] = (cut[1:] - cut[:-1] >= MIN_CHUNK) | (row[1:] != row[:-1])
    ends = np.union1d(cut[apart], offsets[1:][lengths > 0])
    starts = np.concatenate([[0], ends[:-1]])
    more = []
    for k in np.flatnonzero(ends - starts > LONG_CHUNK):
        at, end = int(starts[k]), int(ends[k])
        while end - at > LONG_CHUNK:
            at += 32 + int(gear[at + 32 : at + 64].argmin())
            more.append(at)
    ends = np.union1d(ends, np.array(more, ends.dtype))
    # No chunk ends inside a character: ends move on past continuation bytes.
    for _ in range(3):
        ends = ends + ((ends < len(data)) & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80))
    ends = np.unique(ends)
    row = np.searchsorted(offsets, ends, side="left") - 1
    starts = np.concatenate([[0], ends[:-1]])
    return row, starts, ends


def _ids(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("ver")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = byte_buffer(batch.column("text"))
            row, start, end = chunk_spans(data, offsets)
            if not len(row):
                continue
            raw, digest = data.tobytes(), hashlib.blake2b
            h = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            space = SPACE[data]
            begins = ~space
            begins[1:] &= space[:-1]
            upto = np.concatenate([[0], np.cumsum(begins)])
            doc, ver = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            pair = np.flatnonzero(row[:-1] == row[1:])
            # Pairs only tell whether chunks belong together: 64 bits do.
            both = mix64(h[pair, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(h[pair + 1, 0])).view(np.int64)
            cols = [doc[row], ver[row], start - offsets[row], end - start, upto[end] - upto[start]]
            for kind, hashes, at in ((0, [h[:, 0], h[:, 1]], slice(None)), (1, [both, np.zeros(len(pair), np.int64)], pair)):
                rows = [*hashes, *[c[at] for c in cols], np.full(len(hashes[0]), kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["h1", "h2", "doc", "ver", "place", "length", "words", "pair"])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, ver, place, length, words and first_doc of the chunks that are in
    several documents (the smallest one holds the first occurrence), and linked:
    whether the pair with the next chunk is in several documents (pair_first holds
    its first occurrence)."""
    rows = docs.select(*_ids(id_col, text_col), text_or_empty(text_col).alias("text")).mapInArrow(_chunks, "h1 long, h2 long, doc long, ver long, place long, length long, words long, pair long")
    # Chunking twice (once for the bounds of the ranges) costs less than the disk to keep them.
    found = repeated(rows, ["h1", "h2"], 2, "chunk-runs")
    of = lambda c: F.max(F.when(F.col("pair") == 0, F.col(c))).alias(c)
    by_place = found.groupBy("doc", "ver", "place").agg(of("length"), of("words"), of("first_doc"), F.max(F.when(F.col("pair") == 1, F.col("first_doc"))).alias("pair_first"))
    return by_place.filter("length is not null").withColumn("linked", F.col("pair_first").isNotNull())


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Repeated chunks with the number of their run of neighbouring ones, and of the
    part of it in which first_doc stays the same."""
    by = Window.partitionBy("doc", "ver").orderBy("place")
    follows = (F.lag(F.col("place") + F.col("length")).over(by) == F.col("place")) & F.lag("linked").over(by)
    # A chunk next to others is where its pair is: alone it may be anywhere by chance.
    first = F.coalesce(F.least(F.when(F.lead("joined").over(by), F.col("pair_first")), F.when(F.col("joined"), F.lag("pair_first").over(by))), F.col("first_doc"))
    return (
        repeated_chunks(docs, id_col, text_col)
        .withColumn("joined", F.coalesce(follows, F.lit(False)))
        .withColumn("first_doc", first)
        .withColumn("first", F.col("doc") == F.col("first_doc"))
        .withColumn("new", ~F.col("joined"))
        .withColumn("other", F.col("new") | (F.lag("first_doc").over(by) != F.col("first_doc")))
        .withColumn("run", F.sum(F.col("new").cast("int")).over(by))
        .withColumn("part", F.sum(F.col("other").cast("int")).over(by))
    )


def _spans(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("doc", "ver", *keys).agg(
        F.min("place").alias("start"),
        F.max(F.col("place") + F.col("length")).alias("end"),
        F.sum("words").alias("words"),
        F.min("first_doc").alias("first_doc"),
        F.bool_and("first").alias("is_first"),
    )


def repeated_passages(docs: DataFrame, min_words: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: doc, ver, start and end (bytes of the text in UTF-8),
    words, first_doc, and is_first where all of the passage is the first occurrence.

    A passage is a run of neighbouring chunks that other documents have as well, next to
    each other.
    Whole chunks lie within a repeated passage only, so a passage of 50 words
    shows with fewer; min_words counts what is shown.  What may be cut is told by
    passage_parts.
    """
    return _spans(_runs(docs, id_col, text_col), "run").filter(F.col("words") >= min_words).drop("run")


def passage_parts(docs: DataFrame, min_words: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages of min_words words or more, split where first_doc changes: a row
    of the same columns per part.  What a document is the first to have is a part
    with is_first, whatever it lies next to."""
    parts = _spans(_runs(docs, id_col, text_col), "run", "part").withColumn("whole", F.sum("words").over(Window.partitionBy("doc", "ver", "run")))
    return parts.filter(F.col("whole") >= min_words).drop("run", "part", "whole")


def cut_repeats(docs: DataFrame, min_words: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that an earlier document has; same columns."""
    later = passage_parts(docs, min_words, id_col, text_col).filter("not is_first")
    spans = later.groupBy("doc", "ver").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*_ids(id_col, text_col), row).join(spans, ["doc", "ver"], "left").select("row", F.col(f"row.`{text_col}`").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, at, kept = texts[i].encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType).add("text", "string"))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
