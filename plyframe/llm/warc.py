"""WARC archives: a parallel writer and a splittable reader.

Writer: one archive per task, each record a gzip member of its own.  Of records
with equal payloads of at least `min_bytes`, the one with the largest id is a
response and the others are revisits of it.  Only responses carry a payload, and
each payload travels once.  Archives get a unique name per
attempt; a manifest that Spark commits names the ones that count, so retried
tasks leave no trace in what is read.

Reader: archives are cut into byte ranges.  A task scans its range for gzip
magic, takes a candidate as a member if its first bytes decode to a WARC
header, and owns the records whose member starts inside the range; from there
members follow each other, and the last may end beyond the range.

Null payloads count as empty, null urls as the empty address.  Null ids are
written as the empty id and lose against any id.  Of rows that repeat id and
payload the one with the largest url is the response, of rows equal in all one.
A very long payload is one record; it is written and read in the task that has
it.  Columns other than id, url and html are not looked at, so their names can't
clash.  An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_path, slices, written

MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes looked at to decide whether a member starts at a candidate.
PROBE = 512
#: Bytes read from a file, and given to a decoder, at once.
BLOCK, FEED = 1 << 20, 1 << 13


# ---------------------------------------------------------------- writing


def record_bytes(kind: str, record_id: str, url: str, payload: bytes | None, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member.  A revisit has no block; the length
    of its payload is kept in an extension field."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload or b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def assign_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """One row per page: id, url, digest (hex), payload_bytes, is_response, and first (the
    id of the response, for revisits).  Equal rows are counted first, map-side, so no
    group of copies is gathered; a digest's one top row is joined to what is left."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    counts = rows.groupBy("id", "url", "digest", "payload_bytes").agg(F.count("*").alias("copies"))
    tops = counts.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("top"))
    told = counts.join(tops, "digest").withColumn("is_top", F.struct("id", "url").eqNullSafe(F.col("top")))
    each = told.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    response = (F.col("payload_bytes") < min_bytes) | (F.col("is_top") & (F.col("nth") == 1))
    return each.select("id", "url", "digest", "payload_bytes", response.alias("is_response"), F.when(~response, F.col("top.id")).alias("first"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as archives; the manifest (path, length) as a DataFrame."""
    folder = shared_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    told = written(assign_revisits(pages, id_col, url_col, html_col, min_bytes), "warc-records")
    bodies = pages.select(F.sha1(payload).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    responses = told.filter("is_response").join(bodies, "digest").select("id", "url", "digest", "payload_bytes", "is_response", "first", "payload")
    rows = responses.unionByName(told.filter("not is_response").withColumn("payload", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, length = None, None, 0
        for batch in (part for whole in batches for part in slices(whole, "payload")):
            for doc, url, digest, size, response, refers, payload in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "digest", "payload_bytes", "is_response", "first", "payload")), strict=True):
                if sink is None:
                    fs, inner = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(inner, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    sink, path = fs.open_output_stream(f"{inner}/{name}", compression=None), f"{folder}/{name}"
                name = "" if doc is None else str(doc)
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                refers_to = None if response else "" if refers is None else str(refers)
                data = record_bytes("response" if response else "revisit", name, url.replace("\r", "%0D").replace("\n", "%0A"), payload, bare, size, refers_to)
                sink.write(data)
                length += len(data)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64())], names=["path", "length"])

    return written(rows.mapInArrow(run, "path string, length long"), "warc-manifest")


# ---------------------------------------------------------------- reading


def _is_member(data: bytes, at: int) -> bool:
    """Whether a WARC record starts at a gzip member here."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + PROBE], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of a decoded record."""
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length:
        raise ValueError("a WARC record ends before its Content-Length")
    return fields, block


class _Window:
    """A growing window on a file: bytes from `base` on."""

    def __init__(self, file, base: int):
        self.file, self.base, self.data, self.done = file, base, bytearray(), False
        file.seek(base)

    def more(self) -> bool:
        block = b"" if self.done else self.file.read(BLOCK)
        self.done = not block
        self.data += block
        return bool(block)

    def forget(self, upto: int) -> None:
        """Drop what lies before the file position upto."""
        del self.data[: upto - self.base]
        self.base = upto


def records_in_range(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(file position, decoded record) of the members that start in [start, end)."""
    window, at, synced = _Window(file, start), start, False
    window.more()
    while at < end:
        if not synced:
            found = window.data.find(MAGIC, at - window.base)
            if found < 0:
                # Keep what may be the first bytes of a magic number.
                upto = max(at, window.base + len(window.data) - len(MAGIC) + 1)
                window.forget(upto)
                at = upto
                if not window.more():
                    return
                continue
            at = window.base + found
            while len(window.data) - found < PROBE and window.more():
                pass
            if at >= end:
                return
            if not _is_member(window.data, found):
                at += 1
                continue
            synced = True
        decoder, parts, fed = zlib.decompressobj(31), [], at - window.base
        while not decoder.eof:
            if fed >= len(window.data) and not window.more():
                if fed == at - window.base:
                    return
                raise ValueError(f"a gzip member at {at} is cut off")
            parts.append(decoder.decompress(bytes(window.data[fed : fed + FEED])))
            fed = min(fed + FEED, len(window.data))
        member_end = window.base + fed - len(decoder.unused_data)
        record = b"".join(parts)
        if record.startswith(b"WARC/"):
            yield at, record
        at = member_end
        window.forget(at)
        if at < end:
            while len(window.data) < len(MAGIC) and window.more():
                pass
            synced = window.data[: len(MAGIC)] == MAGIC
            if not window.data:
                return


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives under a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")


def read_archives(archives: DataFrame, split_bytes: int = 16 << 20, block: bool = True) -> DataFrame:
    """The records of archives given as (path, length): path, position, fields
    (map), block bytes, and the block's size and digest (base32 SHA-1, as headers
    have it).  Set block=False to leave
    the bytes in the task that decoded them."""
    ranges = archives.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")).select("path", "start", F.least(F.col("length"), F.col("start") + split_bytes).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        names = ["path", "position", "fields", "block_bytes", "block_sha1", "block"]
        out, size = [[] for _ in kinds], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    for at, record in records_in_range(file, start, end):
                        fields, body = parse_record(record)
                        for column, value in zip(out, (path, at, list(fields.items()), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body if block else None), strict=True):
                            column.append(value)
                        size += len(body) * block + 300
                        if size > 8 << 20:
                            yield full()
                            out, size = [[] for _ in kinds], 0
        if out[0]:
            yield full()

    spread = ranges.repartition("path", "start")
    return spread.mapInArrow(run, "path string, position long, fields map<string,string>, block_bytes long, block_sha1 string, block binary")


def page_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A response's bytes must agree with its own header in length and digest."""
    named = lambda field: F.col("fields")[field]
    page = lambda field: F.regexp_extract(named(field), r"urn:page:(-?\d+)", 1)
    to_id = lambda field: F.when(page(field) != "", page(field).cast("long"))
    length = named("x-payload-length").cast("long")
    digest = F.regexp_replace(named("warc-payload-digest"), "^sha1:", "")
    sound = (named("warc-type") != "response") | ((length == F.col("block_bytes")) & (digest == F.col("block_sha1")))
    return records.select(
        to_id("warc-record-id").alias("page_id"),
        F.when(sound, length).otherwise(F.raise_error(F.concat(F.lit("a payload that its header does not agree with in "), F.col("path"))).cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        named("warc-type").alias("record_type"),
        to_id("warc-refers-to").alias("refers_to"),
    )
