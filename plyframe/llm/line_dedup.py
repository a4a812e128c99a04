"""Line deduplication with per-document keep bitmaps.

A line's key is the line without white space at both ends, A-Z lower-cased.
Hashes of keys are range-partitioned with a secondary sort by document and
position and streamed; the first document in that order keeps its lines.  What
comes back is no text but one compressed bitmap per document that loses lines;
the documents meet their bitmaps once, at the end.

Null or empty text is one empty line.  Null ids are one document, smaller than
any other.  Rows that repeat an id are one document too, each keeping or losing
its own lines.  A very long text is one row in the tasks that split it and that
drop its lines.  Columns other than id and text are not looked at, so their names
can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WHITE, slices, text_or_empty, written
from ._sorted_runs import repeated

NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _ids(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("ver")]


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ver, place) of the lines that go; ver is a hash of the row's text."""
    lines = docs.select(*_ids(id_col, text_col), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("place", "line"))
    keyed = lines.select("doc", "ver", F.col("place").cast("long").alias("place"), line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    rows = written(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "ver", "place"), "line-hashes")
    return repeated(rows, ["h1", "h2"], min_docs, "line-runs", largest_first=True).filter(F.col("doc") != F.col("first_doc")).select("doc", "ver", "place")


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places"):
            at = np.array(places.values)
            keep = np.ones(int(at.max()) + 1, bool)
            keep[at] = False
            keep = np.concatenate([keep, np.ones(-len(keep) % 8, bool)])  # whole bytes; lines past the end stay
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("ver"), pa.array(maps, pa.binary())], names=["doc", "ver", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, ver and bitmap (zlib of packed bits; lines past its end stay) for the
    documents that lose lines."""
    gone = dropped_lines(docs, min_chars, min_docs, id_col, text_col)
    return gone.groupBy("doc", "ver").agg(F.collect_set("place").alias("places")).mapInArrow(_bitmap, "doc long, ver long, bitmap binary")


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[:n_lines]
        keep[: len(bits)] = bits
    return keep


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: id, n_lines, n_dropped, kept_sha256 and, with_text, the kept text."""
    maps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_ids(id_col, text_col), text_or_empty(text_col).alias("text"))
    joined = rows.join(maps, ["doc", "ver"], "left").select("id", "text", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            total, gone, digest, kept = [], [], [], []
            for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
                if bitmap is None:
                    total.append(text.count("\n") + 1)
                    gone.append(0)
                else:
                    lines = text.split("\n")
                    stay = read_bitmap(bitmap, len(lines)).tolist()
                    total.append(len(lines))
                    gone.append(len(lines) - sum(stay))
                    text = "\n".join([x for x, s in zip(lines, stay, strict=True) if s])
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                if with_text:
                    kept.append(text)
            cols = [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=names + ["text"] * with_text)

    return joined.mapInArrow(run, "id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text)
