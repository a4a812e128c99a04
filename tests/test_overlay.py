"""What an overlay shows: lines, boxes and labels."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from plyframe.operators import images as im
from plyframe.operators import pages


def unpacked(png):
    """Pixels of a PNG as our writer makes it (no filters)."""
    width, height = struct.unpack(">II", png[16:24])
    size = struct.unpack(">I", png[33:37])[0]
    rows = np.frombuffer(zlib.decompress(png[41 : 41 + size]), np.uint8).reshape(height, -1)
    return rows[:, 1:].reshape(height, width, 3)


def test_boxes_labels_and_lines(spark):
    page = (80, 100, bytearray(b"\xc8" * 8000))
    box = "struct<kind:string,move_no:int,side:string,pit_index:int,x:int,y:int,w:int,h:int>"
    boxes = [("move", 1, "W", 0, 10, 10, 40, 30), ("pit", 10, "B", 3, 60, 50, 20, 20), ("kazan", 10, "W", 0, 90, 70, 0, 0)]
    lines = [(0.0, 5.0, 99.0, 5.0), (-10.0, 79.0, 200.0, 79.0)]
    df = spark.createDataFrame([(page, boxes, ["48x", None, "9"], lines), (page, None, None, None), (None, boxes, None, None)], f"image {im.IMAGE}, boxes array<{box}>, labels array<string>, lines array<struct<x0:double,y0:double,x1:double,y1:double>>")
    drawn = [r.o for r in df.select(pages.overlay(F.col("image"), F.col("boxes"), F.col("labels"), F.col("lines")).alias("o")).collect()]
    assert drawn[1] is None and drawn[2] is None
    got = unpacked(bytes(drawn[0]))
    line, move, pit = (np.array(pages.COLORS[k]) for k in ("line", "move", "pit"))
    assert (got[5] == line).all() and (got[79] == line).all() and (got[0, 0] == 200).all()
    assert (got[10, 10:51] == move).all() and (got[40, 10:51] == move).all() and (got[10:41, 50] == move).all()
    assert (got[50, 60:81] == pit).all() and (got[70:79, 90:] == 200).all()
    red = (got == np.array(pages.LABEL)).all(axis=2)
    ys, xs = np.nonzero(red)
    assert (ys.min(), ys.max()) == (28, 37) and xs.min() == 12 and xs.max() == 12 + 2 * (4 * 2 + 3) - 1
    dots = sum(bin(int(r)).count("1") for c in "48x" for r in pages.FONT[c])
    assert red.sum() == 4 * dots


def test_lines_of_a_grid(spark):
    line = lambda y: (0.0, float(y))
    grid = ([0.0, 300.0, 600.0, 900.0], [200.0, 500.0, 800.0, 1100.0], [line(10), line(700)], [line(340), line(1030)], 30.0)
    kind = "struct<x0:array<double>,x1:array<double>,top:array<struct<slope:double,offset:double>>,bottom:array<struct<slope:double,offset:double>>,cell:double>"
    rows = spark.createDataFrame([(grid,)], f"g {kind}").select(pages.grid_lines(F.col("g")).alias("l")).first().l
    assert len(rows) == 8 * 16
    first = [tuple(r) for r in rows[:16]]
    assert first[0] == (0.0, 10.0, 200.0, 10.0) and first[11] == (0.0, 340.0, 200.0, 340.0)
    assert [r[0] for r in first[12:]] == [0.0, 40.0, 120.0, 200.0] and first[13][1:] == (10.0, 40.0, 340.0)
