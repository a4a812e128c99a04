"""Pixel operators on gray images, as Columns of Arrow-batched pandas UDFs.

An image is a struct of height, width (int) and pixels (binary, one byte a pixel,
row by row).  Every operator works on one image by itself, so nothing shuffles.
A null image, or one whose pixels do not fill its size, gives a struct of nulls
(null scores).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGE = "struct<height:int,width:int,pixels:binary>"

#: The classifier's input, the weights of gray, the shifts of views.
INPUT_HEIGHT, INPUT_WIDTH = 64, 128
GRAY_RED, GRAY_GREEN, GRAY_BLUE, GRAY_BITS = 19595, 38470, 7471, 16
SHIFTS = [(0, 0), (-2, 0), (2, 0), (0, -2), (0, 2), (-2, -2), (2, 2)]
#: Fixed values of the local threshold: side of the window, and how much darker ink is.
WINDOW, DARKER = 25, 12


def _pixels(height, width, raw) -> np.ndarray | None:
    if raw is None or pd.isna(height) or pd.isna(width) or len(raw) != int(height) * int(width) or not raw:
        return None
    return np.frombuffer(raw, np.uint8).reshape(int(height), int(width))


def _row(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "pixels": np.ascontiguousarray(image).tobytes()}


def _struct_udf(work: Callable[..., dict | None], schema: str):
    """A UDF that applies work to each image (and further values) of an Arrow batch."""
    names = StructType.fromDDL(schema).fieldNames()

    def over(image: pd.DataFrame, *more: pd.Series) -> pd.DataFrame:
        rows = []
        for height, width, raw, *values in zip(image["height"], image["width"], image["pixels"], *more):
            gray = _pixels(height, width, raw)
            rows.append((None if gray is None else work(gray, *values)) or dict.fromkeys(names))
        return pd.DataFrame(rows, columns=names, dtype=object)

    def plain(image: pd.DataFrame) -> pd.DataFrame:
        return over(image)

    def with_box(image: pd.DataFrame, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        return over(image, x0, y0, x1, y1)

    return lambda *columns: F.pandas_udf(with_box if len(columns) > 1 else plain, schema)(*columns)


def gray(image: Column) -> Column:
    """Gray pixels of a row of Spark's `image` source (1, 3 or 4 channels, BGR order)."""

    def convert(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for height, width, channels, raw in zip(rows["height"], rows["width"], rows["nChannels"], rows["data"]):
            if raw is None or channels not in (1, 3, 4):
                out.append(dict.fromkeys(("height", "width", "pixels")))
                continue
            planes = np.frombuffer(raw, np.uint8).reshape(int(height), int(width), int(channels)).astype(np.int64)
            if channels == 1:
                one = planes[:, :, 0]
            else:
                one = (planes[:, :, 0] * GRAY_BLUE + planes[:, :, 1] * GRAY_GREEN + planes[:, :, 2] * GRAY_RED + (1 << GRAY_BITS - 1)) >> GRAY_BITS
            out.append(_row(one.astype(np.uint8)))
        return pd.DataFrame(out, columns=["height", "width", "pixels"], dtype=object)

    return F.pandas_udf(convert, IMAGE)(image)


def crop(image: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box from (x0, y0) to before (x1, y1), corners cut to integers and clamped
    to the image; an empty or null box gives nulls."""

    def cut(pixels, x0, y0, x1, y1):
        if any(pd.isna(v) for v in (x0, y0, x1, y1)):
            return None
        part = pixels[int(max(0, y0)) : int(max(0, min(pixels.shape[0], y1))), int(max(0, x0)) : int(max(0, min(pixels.shape[1], x1)))]
        return _row(part) if part.size else None

    return _struct_udf(cut, IMAGE.removeprefix("struct<").removesuffix(">"))(image, x0, y0, x1, y1)


def with_views(images: DataFrame, image: str = "image") -> DataFrame:
    """Seven rows an image, each shifted a little: `view` and the cropped image."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in SHIFTS])
    rows = images.select("*", F.posexplode(shifts).alias("view", "_by"))
    box = [
        F.greatest(F.lit(0), F.col("_by.dx")),
        F.greatest(F.lit(0), F.col("_by.dy")),
        F.col(f"{image}.width") + F.least(F.lit(0), F.col("_by.dx")),
        F.col(f"{image}.height") + F.least(F.lit(0), F.col("_by.dy")),
    ]
    return rows.withColumn(image, crop(F.col(image), *box)).drop("_by")


def _taps(given: int, wanted: int) -> np.ndarray:
    """wanted x given weights of a triangle filter, widened when shrinking."""
    scale = given / wanted
    reach = max(scale, 1.0)
    centre = (np.arange(wanted)[:, None] + 0.5) * scale
    weight = np.clip(1 - np.abs((np.arange(given)[None, :] + 0.5 - centre) / reach), 0, None)
    return weight / weight.sum(axis=1, keepdims=True)


def _resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Along x, rounded to bytes, then along y."""
    across = np.floor(image @ _taps(image.shape[1], width).T + 0.5)
    return np.floor(_taps(image.shape[0], height) @ across + 0.5)


def model_input(image: np.ndarray) -> np.ndarray:
    """Padded to 2:1 in the border's median, resized, scaled to -1..1."""
    height, width = image.shape
    wide = width * INPUT_HEIGHT >= height * INPUT_WIDTH
    full_h = round(width * INPUT_HEIGHT / INPUT_WIDTH) if wide else height
    full_w = width if wide else round(height * INPUT_WIDTH / INPUT_HEIGHT)
    full_h = max(full_h, height)
    edges = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    paper = np.full((full_h, full_w), int(np.median(edges)), np.float64)
    top, left = (full_h - height) // 2, (full_w - width) // 2
    paper[top : top + height, left : left + width] = image
    return ((_resized(paper, INPUT_HEIGHT, INPUT_WIDTH) / 255 - 0.5) / 0.5).astype(np.float32)


def onnx_runner(model: bytes) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A factory for `logits`: a session of an ONNX model made once a task."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})[0]

    return load


def logits(image: Column, runner: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 64) -> Column:
    """array<float> of a classifier for each image, `batch` images at a time.

    runner is called once a task and returns a function from float32
    (n, 1, 64, 128) to (n, classes).  The model travels with the task, so it is
    for models of some tens of MB.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        classify = runner()
        for part in parts:
            grays = [_pixels(h, w, raw) for h, w, raw in zip(part["height"], part["width"], part["pixels"])]
            good = [i for i, g in enumerate(grays) if g is not None]
            out: list = [None] * len(grays)
            for at in range(0, len(good), batch):
                chosen = good[at : at + batch]
                found = classify(np.stack([model_input(grays[i]) for i in chosen])[:, None])
                for i, scores in zip(chosen, found):
                    out[i] = np.asarray(scores, np.float32)
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(image)


def probabilities(image: Column, runner: Callable[[], Callable[[np.ndarray], np.ndarray]], temperature: float = 1.0, views: bool = True, batch: int = 64) -> Column:
    """array<double> of class probabilities for each image: the mean over its seven
    shifted views of the softmax of a classifier's logits, `batch` views at a time.

    The views are made beside the model, so an image enters Python once.
    """
    shifts = SHIFTS if views else SHIFTS[:1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        classify = runner()
        step = max(1, batch // len(shifts))
        for part in parts:
            grays = [_pixels(h, w, raw) for h, w, raw in zip(part["height"], part["width"], part["pixels"])]
            good = [i for i, g in enumerate(grays) if g is not None]
            out: list = [None] * len(grays)
            for at in range(0, len(good), step):
                chosen = good[at : at + step]
                inputs = [model_input(_shifted(grays[i], dx, dy)) for i in chosen for dx, dy in shifts]
                scores = np.asarray(classify(np.stack(inputs)[:, None]), np.float64) / temperature
                share = np.exp(scores - scores.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                for i, mean in zip(chosen, share.reshape(len(chosen), len(shifts), -1).mean(axis=1)):
                    out[i] = mean
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(image)


def _shifted(image: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The view of with_views; an image too small for a shift stays whole."""
    height, width = image.shape
    view = image[max(0, dy) : height + min(0, dy), max(0, dx) : width + min(0, dx)]
    return view if view.size else image


def _count(mask: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """How many of mask are set from `before` cells back to `after` cells on, inside the image."""
    n = mask.shape[axis]
    sums = np.insert(np.cumsum(mask, axis=axis, dtype=np.int64), 0, 0, axis=axis)
    at = np.arange(n)
    return sums.take(np.minimum(n, at + after + 1), axis) - sums.take(np.maximum(0, at - before), axis)


def _dilated(mask: np.ndarray, length: int, axis: int) -> np.ndarray:
    return _count(mask, length // 2, length - 1 - length // 2, axis) > 0


def _long_runs(mask: np.ndarray, length: int, axis: int) -> np.ndarray:
    """Opening by a line: erosion, then dilation; the outside counts as neither."""
    return _dilated(~_dilated(~mask, length, axis), length, axis)


def _dark(image: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean of their window, the edge pixels repeated outside."""
    reach = WINDOW // 2
    wide = np.pad(image.astype(np.int64), reach, mode="edge")
    sums = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    total = sums[WINDOW:, WINDOW:] - sums[:-WINDOW, WINDOW:] - sums[WINDOW:, :-WINDOW] + sums[:-WINDOW, :-WINDOW]
    return image.astype(np.int64) - np.rint(total / WINDOW**2) <= -DARKER


def _lines(dark: np.ndarray, across: int, down: int) -> np.ndarray:
    """Straight runs of at least these lengths, thickened by a pixel."""
    return _dilated(_dilated(_long_runs(dark, across, 1) | _long_runs(dark, down, 0), 3, 0), 3, 1)


def grid_mask(image: Column) -> Column:
    """255 on the printed lines of a page (runs of a 30th of its width or a 40th of its height)."""

    def mask(pixels):
        height, width = pixels.shape
        return _row(_lines(_dark(pixels), max(1, width // 30), max(1, height // 40)).astype(np.uint8) * 255)

    return _struct_udf(mask, IMAGE.removeprefix("struct<").removesuffix(">"))(image)


def clean_cell(image: Column) -> Column:
    """struct of the cell without printed lines and ink_ratio, the share of ink off
    its margins; cells under three pixels stay as they are, with ratio 0."""

    def clean(pixels):
        height, width = pixels.shape
        if min(height, width) < 3:
            return _row(pixels) | {"ink_ratio": 0.0}
        dark = _dark(pixels)
        lines = _lines(dark, max(3, int(width * 0.6)), max(3, int(height * 0.6)))
        paper = 255 if dark.all() else int(np.median(pixels[~dark]))
        ink = (dark & ~lines)[height // 8 : height - -(-height // 8), width // 12 : width - -(-width // 12)]
        return _row(np.where(lines, paper, pixels).astype(np.uint8)) | {"ink_ratio": float(ink.sum()) / (height * width)}

    return _struct_udf(clean, IMAGE.removeprefix("struct<").removesuffix(">") + ",ink_ratio:double")(image)
