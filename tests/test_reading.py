"""Pages to games with small made-up classifiers, one of them an ONNX model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.operators import images as im
from plyframe.operators import reading
from tests.test_pages import CELL, _df, _sheet


def _field(number, body):
    if isinstance(body, int):
        return _varint(number << 3) + _varint(body)
    body = body.encode() if isinstance(body, str) else body
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _onnx(slope, offset):
    """Mean of the image, times slope, plus offset, as logits."""

    def tensor(name, values):
        dims = b"".join(_field(1, d) for d in values.shape)
        return _field(5, dims + _field(2, 1) + _field(8, name) + _field(9, values.astype("<f4").tobytes()))

    def node(kind, inputs, output):
        return _field(1, b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind))

    def value(number, name, dims):
        shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
        return _field(number, _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape))))

    graph = node("GlobalAveragePool", ["x"], "a") + node("Flatten", ["a"], "b") + node("Gemm", ["b", "w", "c"], "y") + _field(2, "g")
    graph += tensor("w", slope[None]) + tensor("c", offset) + value(11, "x", ["n", 1, 64, 128]) + value(12, "y", ["n", len(offset)])
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_probabilities_of_an_onnx_model(spark):
    slope, offset = np.array([1.0, -2.0, 0.5]), np.array([0.1, 0.2, 0.3])
    cells = [np.random.default_rng(i).integers(0, 256, (20 + i, 50)).astype(np.uint8) for i in range(12)] + [None, np.zeros((2, 2), np.uint8)]
    p = im.probabilities(F.col("image"), im.onnx_runner(_onnx(slope, offset)), temperature=2.0)
    got = [r["p"] for r in _df(spark, cells).select("id", p.alias("p")).orderBy("id").collect()]
    assert got[12] is None and len(got[13]) == 3
    for cell, found in zip(cells[:12], got):
        want = []
        for dx, dy in im.SHIFTS:
            view = cell[max(0, dy) : cell.shape[0] + min(0, dy), max(0, dx) : cell.shape[1] + min(0, dx)]
            e = np.exp((im.model_input(view).mean() * slope + offset) / 2.0)
            want.append(e / e.sum())
        assert np.allclose(found, np.mean(want, axis=0), atol=1e-5)


def test_order_of_classes(spark):
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    assert spark.range(1).select(reading.in_order(p, ["b", "a", "z"], ["a", "b", "c"]).alias("p")).first()["p"] == [0.5, 0.2, 0.0]


def _inked(plies):
    page = _sheet()
    for ply in range(plies):
        x, y = 80 + (48 if ply % 2 == 0 else 144), 60 + (ply // 2 + 1) * CELL
        page[y + 9 : y + 21, x + 30 : x + 60 : 4] = 15
        page[y + 9 : y + 21, x + 31 : x + 60 : 4] = 15
    return page


def _says(names, likely):
    def runner():
        scores = np.zeros(len(names), np.float32)
        scores[names.index(likely)] = 5
        return lambda batch: np.tile(scores, (len(batch), 1))

    return runner


def test_pages_to_games(spark, tmp_path):
    scans = _df(spark, [_inked(3), _inked(0), _sheet(3), None]).withColumnRenamed("id", "sheet")
    moves = _says(reading.MOVE_CLASSES, "99")
    rows = {r["sheet"]: r for r in reading.read_pages(scans, moves, str(tmp_path / "p"), _says(reading.DIAGRAM_CLASSES, "empty"), width=2, views=False).collect()}
    assert len(rows) == 4 and rows[2]["error"] == "found 3 tables, need 8" and rows[3]["error"] == "unreadable image"
    assert rows[0]["plies_scanned"] == 3 and rows[0]["stopped"]["reason"] == "empty cell" and (rows[0]["stopped"]["move"], rows[0]["stopped"]["side"]) == (2, "B")
    assert "99" in rows[0]["raw_pgn"] and rows[0]["beam_plies"] == 3 and rows[0]["error"] is None and rows[0]["coarse"]
    assert rows[1]["plies_scanned"] == 0 and rows[1]["beam_plies"] == 0 and rows[2]["beam_pgn"] is None


@pytest.mark.parametrize("text,width", [("4096", 4096), (" 1024 ", 1024), ("many", 2048), ("", 2048), (None, 2048), ("-3", 1), ("0", 1), ("+5", 5), ("2_000", 2000), ("1e99", 2048), ("9" * 30, (1 << 31) - 1)])
def test_beam_width(spark, text, width):
    row = spark.createDataFrame([(text,)], "t string").select(reading.beam_width(F.col("t")).alias("w")).first()
    assert row["w"] == width and reading.WIDTHS[0] == 1024 and reading.WIDTHS[-1] == 1 << 30


def test_request_error(spark):
    rows = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "n int").select(reading.request_error(F.col("n")).alias("e")).collect()
    assert [r["e"] for r in rows] == ["no images", None, None, "at most 5 images, got 6", "no images"]
