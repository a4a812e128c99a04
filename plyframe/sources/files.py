"""Small file sources and sinks, all with explicit schemas."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .committed import write_files

REPLAY = "halfmove int, player string, move string, p1_kazan int, p2_kazan int, p1_side int, p2_side int, p1_tuzdyk int, p2_tuzdyk int, winner string"


def labels_csv(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """Rows `filename,label` with a header whose trimmed label is in classes(class)."""
    rows = spark.read.schema("filename string, label string").csv(path, header=True)
    trimmed = rows.select(F.trim("filename").alias("filename"), F.trim("label").alias("label"))
    return trimmed.join(classes, F.col("label") == F.col("class"), "left_semi")


def replay_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Replay fixtures: rows that start with a half-move number; the lines above the
    header and the header itself are dropped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\d+\tP[12]\t"))
    return lines.select(F.from_csv("value", REPLAY, {"sep": "\t"}).alias("r")).select("r.*")


def class_list_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names: (idx, class), idx the place in the array."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "class"))


def image_files(spark: SparkSession, folder: str | list[str], pattern: str = "*.jpg", derived: str = "_split") -> DataFrame:
    """Image files of a folder as (path, length, content), without derived ones."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.filter(~F.col("path").rlike(rf"{derived}\.[^./]*$")).select("path", "length", "content")


def write_documents(games: DataFrame, path: str) -> None:
    """One JSON document per row, partitioned by nothing."""
    games.select(F.to_json(F.struct(*games.columns)).alias("value")).write.text(path)


def write_pgn(games: DataFrame, path: str, kind: str = "kind", pgn: str = "pgn") -> None:
    """PGN texts in a folder per kind."""
    games.select(F.col(kind).alias("kind"), F.col(pgn).alias("value")).write.partitionBy("kind").text(path)


def write_records(games: DataFrame, folder: str, name: str = "name", tags: str = "tags", kinds: tuple[str, ...] = ("beam", "raw", "legal"), replace: bool = False) -> None:
    """`<name>_<kind>.pgn` for each game and kind of record (its column is `<kind>_pgn`):
    the tags and then the moves, all committed together."""
    each = [F.struct(F.concat(F.col(name), F.lit(f"_{k}.pgn")).alias("name"), F.concat(F.coalesce(F.col(tags), F.lit("")), F.col(f"{k}_pgn")).alias("content")) for k in kinds]
    write_files(games.select(F.inline(F.array(*each))), folder, replace=replace)


#: Endings of image files, the digits that need glyphs, EXIF's tag of orientation.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
DIGITS = "123456789"
ORIENTATION = 0x0112


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths that match, sorted within each pattern; a pattern without a match stays
    as it is, so that reading it names it in the error."""
    found = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        found += sorted(str(m.getPath().toUri().getPath()) for m in matches or []) or [pattern]
    return found


def exif_orientation(content: bytes) -> int:
    """Orientation 1-8 of a JPEG's EXIF segment; 1 where there is none or it is broken."""
    at = 2
    while content[:2] == b"\xff\xd8" and content[at : at + 1] == b"\xff" and content[at + 1] != 0xDA:
        length = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff_orientation(content[at + 10 : at + 2 + length])
        at += 2 + max(length, 2)
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (start,) = struct.unpack_from(order + "I", tiff, 4)
        (entries,) = struct.unpack_from(order + "H", tiff, start)
        for i in range(entries):
            tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * i)
            if tag == ORIENTATION:
                return value if 1 <= value <= 8 else 1
    except (struct.error, TypeError):
        pass
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are meant to be seen: 2-4 flip, 5-8 swap the sides too."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    across, down = {1: (1, 1), 2: (-1, 1), 3: (-1, -1), 4: (1, -1), 5: (1, 1), 6: (-1, 1), 7: (-1, -1), 8: (1, -1)}[orientation]
    return pixels[::down, ::across]


def sheet_images(spark: SparkSession, folder: str | list[str], pattern: str = "*", derived: str = "_split") -> DataFrame:
    """Gray pages of a folder (or of some files), turned upright by EXIF: (path, image),
    ordered by nothing.

    Spark's image source decodes; it hides EXIF, so the files' bytes are read beside
    it and joined by path.  A file that cannot be decoded has an image of nulls.
    """
    from plyframe.operators.images import IMAGE, _pixels, _row, gray

    def orientation(contents: pd.Series) -> pd.Series:
        return pd.Series([exif_orientation(c) for c in contents], dtype="int32")

    def turn(rows: pd.DataFrame, orientations: pd.Series) -> pd.DataFrame:
        out = []
        for height, width, raw, way in zip(rows["height"], rows["width"], rows["pixels"], orientations):
            page = _pixels(height, width, raw)
            out.append(dict.fromkeys(("height", "width", "pixels")) if page is None else _row(upright(page, int(way))))
        return pd.DataFrame(out, columns=["height", "width", "pixels"], dtype=object)

    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^file:/+", "/")

    ways = image_files(spark, folder, pattern, derived).select(plain(F.col("path")).alias("path"), F.pandas_udf(orientation, "int")("content").alias("way"))
    seen = spark.read.format("image").option("pathGlobFilter", pattern).load(folder).select(plain(F.col("image.origin")).alias("path"), gray(F.col("image")).alias("image"))
    joined = ways.join(seen, "path", "left")
    fields = IMAGE.removeprefix("struct<").removesuffix(">")
    return joined.select("path", F.pandas_udf(turn, fields)("image", "way").alias("image"))


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Images of a folder of folders: (path, class, idx); a class is a folder's name and
    idx its place among the names in order.  Only names are gathered for that."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IMAGE_ENDINGS))
    rows = rows.withColumn("class", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    names = rows.agg(F.array_sort(F.collect_set("class")).alias("names"))
    return rows.join(F.broadcast(names.select(F.posexplode("names").alias("idx", "class"))), "class").select("path", "class", "idx")


def glyph_files(spark: SparkSession, root: str) -> DataFrame:
    """Glyph images under root/ingredients/<char> and root/glyph_data/<source>/<char>:
    (path, source, char).  Raises if a digit from 1 to 9 has none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    place = r"(?:ingredients|glyph_data/(ardis|emnist))/([0-9x])/[^/]+\.(?i:png|jpg|jpeg|bmp)$"
    rows = rows.filter(F.col("path").rlike(place)).select("path", F.regexp_extract("path", place, 1).alias("source"), F.regexp_extract("path", place, 2).alias("char"))
    rows = rows.withColumn("source", F.when(F.col("source") == "", "emnist").otherwise(F.col("source")))
    rows = rows.filter((F.col("char") != "x") | (F.col("source") != "ardis"))
    missing = sorted(set(DIGITS) - {r["char"] for r in rows.select("char").distinct().collect()})
    if missing:
        raise FileNotFoundError(f"no glyph images for digits {', '.join(missing)}")
    return rows


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of gray (height, width) or colour (height, width, 3) bytes."""
    height, width = pixels.shape[:2]
    lines = np.zeros((height, 1 + pixels[0].size), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png(image: Column) -> Column:
    """PNG of a gray image; null for a null or empty one."""
    from plyframe.operators.images import _pixels

    def encode(rows: pd.DataFrame) -> pd.Series:
        grays = [_pixels(h, w, raw) for h, w, raw in zip(rows["height"], rows["width"], rows["pixels"])]
        return pd.Series([None if g is None else png_bytes(g) for g in grays], dtype=object)

    encode.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(encode, "binary")(image)


def write_images(rows: DataFrame, folder: str, name: str = "name", content: str = "content", replace: bool = False) -> None:
    """A file for each row, committed together; null contents make no file."""
    write_files(rows, folder, name, content, replace)
