"""From a scanned page to its cells.

Pixels are worked on in Arrow batches, one page at a time (components, rotation,
crops); everything between them, from tables to boxes, is Column algebra on
arrays of at most a few hundred values.  Nothing shuffles.  A page with fewer
than eight tables, a null page or one that cannot be read gets an error text and
no cells; the rest of the batch goes on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.operators.images import IMAGE, _dark, _lines, _pixels, _row, _struct_udf

FIELDS = IMAGE.removeprefix("struct<").removesuffix(">")
QUAD = "struct<area:double,corners:array<struct<x:double,y:double>>>"

#: Fixed values of the form: tables, rows of a table, largest skew in degrees, edges of
#: the columns as shares of a table, the diagram's gap, row height, left edge and width,
#: the kazan's first pit and width, and the cell height under which a page is coarse.
TABLES, ROWS, MAX_SKEW = 8, 10, 15.0
NUMBER_END, WHITE_END = 0.20, 0.60
GAP, ROW_HEIGHT, LEFT, WIDTH = 2.49, 1.10, -0.1, 1.05
KAZAN_FROM, KAZAN_PITS = 4, 2
COARSE = 35
#: Red, green and blue of move boxes, kazans, pits and grid lines.
COLORS = {"move": (0, 180, 0), "kazan": (0, 120, 200), "pit": (255, 140, 0), "line": (160, 160, 160)}


def _row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of set pixels, in reading order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _components(mask: np.ndarray) -> list[np.ndarray]:
    """Per 8-connected component the ends of its runs as rows (x, y)."""
    row, first, last = _row_runs(mask)
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        above, here = starts[y - 1], starts[y]
        while above < starts[y] and here < starts[y + 1]:
            if first[above] <= last[here] + 1 and first[here] <= last[above] + 1:
                root[find(here)] = find(above)
            if last[above] < last[here]:
                above += 1
            else:
                here += 1
    owner = np.array([find(i) for i in range(len(root))], np.int64)
    order = np.argsort(owner, kind="stable")
    parts = np.split(order, np.nonzero(np.diff(owner[order]))[0] + 1) if len(order) else []
    return [np.concatenate([np.stack([first[p], row[p]], 1), np.stack([last[p], row[p]], 1)]) for p in parts]


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in x and y, without points on its edges."""
    points = np.unique(points, axis=0)

    def half(ordered):
        kept: list = []
        for p in ordered:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    ordered = points.tolist()
    return np.array(half(ordered) + half(ordered[::-1]) or ordered, np.float64)


def _simplified(ring: np.ndarray, allowed: float) -> np.ndarray:
    """Corners of a closed ring such that no other point is further than allowed
    from its side; begins at two far points."""

    def between(part: np.ndarray) -> list:
        a, b = part[0], part[-1]
        along = b - a
        off = np.abs((part[:, 0] - a[0]) * along[1] - (part[:, 1] - a[1]) * along[0]) / max(np.hypot(*along), 1e-9)
        worst = int(off.argmax())
        return [a] if off[worst] <= allowed else between(part[: worst + 1]) + between(part[worst:])

    at = int(((ring - ring[0]) ** 2).sum(1).argmax())
    ring = np.roll(ring, -at, axis=0)
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())
    return np.array(between(ring[: far + 1]) + between(np.vstack([ring[far:], ring[:1]])))


def _least_rectangle(hull: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle round a hull; a side lies on one of its edges."""
    best = None
    for along in np.roll(hull, -1, axis=0) - hull:
        length = np.hypot(*along)
        if length == 0:
            continue
        axes = np.array([along, [-along[1], along[0]]]) / length
        low, high = (hull @ axes.T).min(0), (hull @ axes.T).max(0)
        area = float(np.prod(high - low))
        if best is None or area < best[0]:
            best = area, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
    return hull[[0, 0, 0, 0]] if best is None else best[1]


def _quad(points: np.ndarray) -> dict:
    """Four corners of a component, from the top left on clockwise, and their area."""
    hull = _hull(points)
    length = np.hypot(*(np.roll(hull, -1, axis=0) - hull).T).sum()
    corners = _simplified(hull, 0.02 * length) if len(hull) > 2 else hull
    if len(corners) != 4:
        corners = _least_rectangle(hull)
    total, apart = corners.sum(1), corners[:, 1] - corners[:, 0]
    q = corners[[total.argmin(), apart.argmin(), total.argmax(), apart.argmax()]]
    turned = np.roll(q, -1, axis=0)
    area = abs(float((q[:, 0] * turned[:, 1] - q[:, 1] * turned[:, 0]).sum())) / 2
    return {"area": area, "corners": [{"x": float(x), "y": float(y)} for x, y in q]}


def components(image: Column) -> Column:
    """array of quads: the connected printed lines wider than a tenth of the page and
    higher than a tenth of it.  Null for a null image."""

    def find(pixels: np.ndarray) -> dict:
        height, width = pixels.shape
        mask = _lines(_dark(pixels), max(1, width // 30), max(1, height // 40))
        large = [p for p in _components(mask) if all(np.ptp(p, axis=0) + 1 > np.array([width, height]) * 0.1)]
        return {"quads": [_quad(p) for p in large]}

    return _struct_udf(find, f"quads:array<{QUAD}>")(image)["quads"]


def tables(found: Column) -> Column:
    """The eight tables of a page's quads, upper four and lower four, each from the left.

    Quads of half to twice the median area are taken if there are eight such, else
    all; the eight largest of them stay (ties: as found).  Null if fewer than eight.
    """

    def total(quad: Column, axis: str) -> Column:
        return F.aggregate(quad["corners"], F.lit(0.0), lambda total, p: total + p[axis])

    def ordered(quads: Column, key) -> Column:
        keyed = F.transform(quads, lambda q, i: F.struct(key(q).alias("key"), i.alias("at"), q.alias("quad")))
        return F.transform(F.array_sort(keyed, _by_key), lambda s: s["quad"])

    def middle(quads: Column) -> Column:
        areas = F.array_sort(F.transform(quads, lambda q: q["area"]))
        n = F.size(quads)
        return let(areas, lambda a: (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)

    def near(quads: Column) -> Column:
        return let(middle(quads), lambda m: F.filter(quads, lambda q: (q["area"] > 0.5 * m) & (q["area"] < 2.0 * m)))

    def chosen(quads: Column) -> Column:
        best = let(near(quads), lambda c: F.when(F.size(c) >= TABLES, c).otherwise(quads))
        return F.slice(ordered(best, lambda q: -q["area"]), 1, TABLES)

    def bands(quads: Column) -> Column:
        down = ordered(chosen(quads), lambda q: total(q, "y"))
        return let(down, lambda d: F.concat(*[ordered(F.slice(d, at, 4), lambda q: total(q, "x")) for at in (1, 5)]))

    return let(found, lambda quads: F.when(F.size(quads) >= TABLES, bands(quads)))


def let(value: Column, body) -> Column:
    """body(value) with the value named, not copied to each place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_key(a: Column, b: Column) -> Column:
    less = (a["key"] < b["key"]) | ((a["key"] == b["key"]) & (a["at"] < b["at"]))
    return F.when(less, F.lit(-1)).otherwise(F.lit(1))


def skew(quads: Column) -> Column:
    """Median angle of the upper and lower edges in degrees, within 15; 0 if under 0.05,
    null without tables."""

    def angle(quad: Column, start: int, end: int) -> Column:
        a, b = F.get(quad["corners"], start), F.get(quad["corners"], end)
        return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))

    def clipped(middle: Column) -> Column:
        within = F.greatest(F.lit(-MAX_SKEW), F.least(F.lit(MAX_SKEW), middle))
        return F.when(F.abs(middle) < 0.05, F.lit(0.0)).when(middle.isNotNull(), within)

    edges = F.array_sort(F.flatten(F.transform(quads, lambda q: F.array(angle(q, 0, 1), angle(q, 3, 2)))))
    return let(let(edges, lambda e: (F.get(e, TABLES - 1) + F.get(e, TABLES)) / 2), clipped)


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of four neighbours for a point t after the second (sharpness -0.75)."""
    a = -0.75
    near = [(a + 2) * d**3 - (a + 3) * d**2 + 1 for d in (t, 1 - t)]
    far = [a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a for d in (1 + t, 2 - t)]
    return [far[0], near[0], near[1], far[1]]


def _rotated(pixels: np.ndarray, degrees: float, block: int = 256) -> np.ndarray:
    """Turned about the centre so that a line at this angle lies level; the outside
    has the page's median.  Rows are made in blocks, to bound the memory."""
    height, width = pixels.shape
    turn, paper = np.radians(degrees), float(int(np.median(pixels)))
    ring = np.pad(pixels.astype(np.float32), 4, constant_values=paper)
    x = np.arange(width) - width / 2
    out = np.empty_like(pixels)
    for top in range(0, height, block):
        y = np.arange(top, min(height, top + block))[:, None] - height / 2
        sx = np.clip(np.cos(turn) * x - np.sin(turn) * y + width / 2, -3, width + 1)
        sy = np.clip(np.sin(turn) * x + np.cos(turn) * y + height / 2, -3, height + 1)
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        across, down = _cubic(sx - x0), _cubic(sy - y0)
        total = np.zeros(sx.shape)
        for i in range(4):
            for j in range(4):
                total += down[i] * across[j] * ring[y0 + i + 3, x0 + j + 3]
        out[top : top + block] = np.clip(np.rint(total), 0, 255)
    return out


def rotate(image: Column, degrees: Column) -> Column:
    """The page with lines of this angle laid level; 0 or null leaves it as it is."""

    def over(rows: pd.DataFrame, angles: pd.Series) -> pd.DataFrame:
        out = []
        for height, width, raw, angle in zip(rows["height"], rows["width"], rows["pixels"], angles):
            page = _pixels(height, width, raw)
            if page is None:
                out.append(dict.fromkeys(("height", "width", "pixels")))
            else:
                out.append(_row(page if pd.isna(angle) or angle == 0 else _rotated(page, float(angle))))
        return pd.DataFrame(out, columns=["height", "width", "pixels"], dtype=object)

    over.__annotations__ = {"rows": pd.DataFrame, "angles": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, FIELDS)(image, degrees)


def grid(quads: Column) -> Column:
    """struct of a page's grid from its eight tables: the columns' edges, both bands
    averaged; lines (slope, offset) through each band's upper and lower edges; and the
    height of a cell, an eleventh of the mean table."""

    def along(quad: Column, axis: str) -> Column:
        return F.transform(quad["corners"], lambda p: p[axis])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def edge(boxes: Column, name: str) -> Column:
        return F.array(*[(F.get(boxes, c)[name] + F.get(boxes, c + 4)[name]) / 2 for c in range(4)])

    def line(boxes: Column, band: int, name: str) -> Column:
        part = F.slice(boxes, 4 * band + 1, 4)
        means = F.struct((total(F.transform(part, lambda b: (b["x0"] + b["x1"]) / 2)) / 4).alias("x"), (total(F.transform(part, lambda b: b[name])) / 4).alias("y"))

        def fit(mean: Column) -> Column:
            spread = total(F.transform(part, lambda b: F.pow((b["x0"] + b["x1"]) / 2 - mean["x"], F.lit(2.0))))
            joint = total(F.transform(part, lambda b: ((b["x0"] + b["x1"]) / 2 - mean["x"]) * (b[name] - mean["y"])))
            slope = F.coalesce(F.try_divide(joint, spread), F.lit(0.0))
            return let(slope, lambda s: F.struct(s.alias("slope"), (mean["y"] - s * mean["x"]).alias("offset")))

        return let(means, fit)

    def of(boxes: Column) -> Column:
        return F.struct(
            edge(boxes, "x0").alias("x0"),
            edge(boxes, "x1").alias("x1"),
            F.array(line(boxes, 0, "y0"), line(boxes, 1, "y0")).alias("top"),
            F.array(line(boxes, 0, "y1"), line(boxes, 1, "y1")).alias("bottom"),
            (total(F.transform(boxes, lambda b: b["y1"] - b["y0"])) / TABLES / (ROWS + 1)).alias("cell"),
        )

    boxes = F.transform(
        quads,
        lambda q: F.struct(
            F.array_min(along(q, "x")).alias("x0"),
            F.array_min(along(q, "y")).alias("y0"),
            F.array_max(along(q, "x")).alias("x1"),
            F.array_max(along(q, "y")).alias("y1"),
        ),
    )
    return let(boxes, of)


def _table_parts(found: Column, i: Column, per: int) -> tuple[Column, Column, Column, Column]:
    """Of box i with `per` boxes a table: table number, left edge, width, and centre."""
    table = F.floor(i / per).cast("int")
    left, right = F.get(found["x0"], table % 4), F.get(found["x1"], table % 4)
    return table, left, right - left, (left + right) / 2


def _at(line: Column, x: Column) -> Column:
    return line["slope"] * x + line["offset"]


def _box(kind: str, move_no: Column, side: Column, pit: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    whole = [F.lit(kind).alias("kind"), move_no.cast("int").alias("move_no"), side.alias("side"), pit.cast("int").alias("pit_index")]
    return F.struct(*whole, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def move_boxes(found: Column) -> Column:
    """The 160 boxes of moves of a grid: number 1-80, side W or B."""

    def box(i: Column) -> Column:
        table, left, width, centre = _table_parts(found, i, 2 * ROWS)
        row, white = F.floor(i / 2).cast("int") % ROWS, i % 2 == 0
        y0 = _at(F.get(found["top"], F.floor(table / 4).cast("int")), centre) + (row + 1) * found["cell"]
        x0 = left + F.when(white, F.lit(NUMBER_END)).otherwise(F.lit(WHITE_END)) * width
        x1 = left + F.when(white, F.lit(WHITE_END)).otherwise(F.lit(1.0)) * width
        return _box("move", table * ROWS + row + 1, F.when(white, F.lit("W")).otherwise(F.lit("B")), F.lit(0), x0, y0, x1, y0 + found["cell"])

    return F.transform(F.sequence(F.lit(0), F.lit(TABLES * 2 * ROWS - 1)), box)


def diagram_boxes(found: Column) -> Column:
    """The 160 boxes of diagrams of a grid: 18 pits and 2 kazans for every tenth move.
    Black's pits count 9 to 1 from the left, White's 1 to 9."""
    high = found["cell"] * ROW_HEIGHT

    def frame(i: Column, per: int) -> tuple[Column, Column, Column, Column]:
        table, left, width, centre = _table_parts(found, i, per)
        top = _at(F.get(found["bottom"], F.floor(table / 4).cast("int")), centre) + GAP * found["cell"]
        return (table + 1) * ROWS, left + LEFT * width, WIDTH * width / 9, top

    def pit(i: Column) -> Column:
        move_no, left, width, top = frame(i, 18)
        place, black = i % 9, (i % 18) < 9
        y0 = F.when(black, top).otherwise(top + high)
        index = F.when(black, 9 - place).otherwise(place + 1)
        return _box("pit", move_no, F.when(black, F.lit("B")).otherwise(F.lit("W")), index, left + place * width, y0, left + (place + 1) * width, y0 + high)

    def kazan(i: Column) -> Column:
        move_no, left, width, top = frame(i, 2)
        black = i % 2 == 0
        y0 = F.when(black, top - high).otherwise(top + 2 * high)
        x0 = left + KAZAN_FROM * width
        return _box("kazan", move_no, F.when(black, F.lit("B")).otherwise(F.lit("W")), F.lit(0), x0, y0, x0 + KAZAN_PITS * width, y0 + high)

    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(18 * TABLES - 1)), pit), F.transform(F.sequence(F.lit(0), F.lit(2 * TABLES - 1)), kazan))


def clamped(boxes: Column, image: Column) -> Column:
    """Boxes with integer corners inside the image: x, y, w and h (0 if outside)."""

    def cut(b: Column) -> Column:
        x, y = [F.greatest(F.lit(0.0), b[n]).cast("int") for n in ("x0", "y0")]
        w = F.greatest(F.lit(0), F.least(image["width"], b["x1"]).cast("int") - x)
        h = F.greatest(F.lit(0), F.least(image["height"], b["y1"]).cast("int") - y)
        return F.struct(*[b[n].alias(n) for n in ("kind", "move_no", "side", "pit_index")], x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    return F.transform(boxes, cut)


def crops(image: Column, boxes: Column) -> Column:
    """array of images, one for each clamped box, so that a page enters Python once."""

    def cut(rows: pd.DataFrame, wanted: pd.Series) -> pd.Series:
        out = []
        for height, width, raw, page_boxes in zip(rows["height"], rows["width"], rows["pixels"], wanted):
            page = _pixels(height, width, raw)
            if page is None or page_boxes is None:
                out.append(None)
            else:
                out.append([_row(page[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]) for b in page_boxes])
        return pd.Series(out, dtype=object)

    cut.__annotations__ = {"rows": pd.DataFrame, "wanted": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, f"array<{IMAGE}>")(image, boxes)


def fixed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column that is computed once: a generator of one value keeps the
    optimizer from copying it (a UDF too) to each place that uses it."""
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, F.explode(F.array(value)).alias(name))


def with_layout(pages: DataFrame, image: str = "image") -> DataFrame:
    """Pages turned level, with `boxes` (160 moves, 160 of diagrams), `coarse` (the
    upper median of the move cells is under 35 pixels high) and `error` (null where all is well)."""
    first = fixed(fixed(pages, "_found", components(F.col(image))), "_tables", tables(F.col("_found")))
    level = fixed(first, image, rotate(F.col(image), skew(F.col("_tables")))).drop("_found", "_tables")
    again = fixed(fixed(level, "_found", components(F.col(image))), "_tables", tables(F.col("_found")))
    good = F.size("_found") >= TABLES
    placed = let(grid(F.col("_tables")), lambda g: F.concat(move_boxes(g), diagram_boxes(g)))
    again = fixed(again, "boxes", F.when(good, clamped(placed, F.col(image))))
    heights = F.array_sort(F.transform(F.filter(F.col("boxes"), lambda b: b["kind"] == "move"), lambda b: b["h"]))
    short = F.get(heights, TABLES * ROWS) < COARSE
    text = F.when(F.col("_found").isNull(), "unreadable image").when(~good, F.format_string("found %d tables, need 8", F.size("_found")))
    return again.withColumn("coarse", short).withColumn("error", text).drop("_tables", "_found")


def cells(layout: DataFrame, image: str = "image", failed: bool = False) -> DataFrame:
    """A row a cell of pages with layout: the page's other columns, kind, move_no, side,
    pit_index, bbox and the cell's image.  Pages with an error give no rows, or, with
    `failed`, one row without a cell; coarse and error stay as columns then."""
    left_out = {image, "boxes", "kind", "move_no", "side", "pit_index", "bbox"} | (set() if failed else {"coarse", "error"})
    kept = [c for c in layout.columns if c not in left_out]
    pages = layout if failed else layout.filter(F.col("boxes").isNotNull())
    cut = pages.select(*kept, "boxes", crops(F.col(image), F.col("boxes")).alias("_cut"))
    rows = cut.select(*kept, F.explode_outer(F.arrays_zip(F.col("boxes").alias("box"), F.col("_cut").alias("image"))).alias("_c"))
    box = F.col("_c.box")
    return rows.select(
        *kept,
        *[box[n].alias(n) for n in ("kind", "move_no", "side", "pit_index")],
        F.struct(*[box[n].alias(n) for n in "xywh"]).alias("bbox"),
        F.col("_c.image").alias("image"),
    )


def cell_name(kind: Column, move_no: Column, side: Column, pit_index: Column) -> Column:
    """File name of a cell's crop: 07_W.png, kazan_10_B.png, pit_10_W_3.png."""
    number = F.lpad(move_no.cast("string"), 2, "0")
    tail = F.when(pit_index > 0, F.concat(F.lit("_"), pit_index.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.when(kind == "move", F.lit("")).otherwise(F.concat(kind, F.lit("_"))), number, F.lit("_"), side, tail, F.lit(".png"))


#: Letters of labels, 3 wide and 5 high: a row is a digit whose bits are its dots.
FONT = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717", "x": "05250", "-": "00700", "+": "02720"}
LABEL = (255, 0, 0)


def grid_lines(found: Column) -> Column:
    """Lines of a grid as array<struct<x0, y0, x1, y1>>: of each table the upper edges of
    its rows, the lower edge, and the edges of its three columns."""

    def of(table: Column) -> Column:
        left, right = F.get(found["x0"], table % 4), F.get(found["x1"], table % 4)
        band = F.floor(table / 4).cast("int")
        top = lambda x: _at(F.get(found["top"], band), x)
        line = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
        rows = F.transform(F.sequence(F.lit(0), F.lit(ROWS + 1)), lambda r: line(left, top(left) + r * found["cell"], right, top(right) + r * found["cell"]))
        shares = F.array(*map(F.lit, (0.0, NUMBER_END, WHITE_END, 1.0)))
        columns = F.transform(F.transform(shares, lambda c: left + c * (right - left)), lambda x: line(x, top(x), x, top(x) + (ROWS + 1) * found["cell"]))
        return F.concat(rows, columns)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), of))


def _draw_line(paper: np.ndarray, x0: float, y0: float, x1: float, y1: float, color: tuple[int, int, int]) -> None:
    steps = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
    x, y = (np.rint(np.linspace(a, b, steps + 1)).astype(int) for a, b in ((x0, x1), (y0, y1)))
    inside = (x >= 0) & (y >= 0) & (x < paper.shape[1]) & (y < paper.shape[0])
    paper[y[inside], x[inside]] = color


def _draw_label(paper: np.ndarray, text: str, x: int, bottom: int, scale: int) -> None:
    for place, char in enumerate(text):
        dots = [[int(r) >> 2 & 1, int(r) >> 1 & 1, int(r) & 1] for r in FONT.get(char, "00000")]
        mask = np.kron(dots, np.ones((scale, scale), int)).astype(bool)
        ys, xs = np.nonzero(mask)
        ys, xs = ys + bottom - 5 * scale, xs + x + place * 4 * scale
        inside = (xs >= 0) & (ys >= 0) & (xs < paper.shape[1]) & (ys < paper.shape[0])
        paper[ys[inside], xs[inside]] = LABEL


def overlay(image: Column, boxes: Column, labels: Column | None = None, lines: Column | None = None) -> Column:
    """PNG of a page in colour with its grid's lines (array of x0, y0, x1, y1), the outline
    of every clamped box, and the label of each (array beside the boxes, null for none)
    in its lower left corner; null without boxes."""
    from plyframe.sources.files import png_bytes

    def draw(rows: pd.DataFrame, wanted: pd.Series, texts: pd.Series, grids: pd.Series) -> pd.Series:
        out = []
        for height, width, raw, page_boxes, page_texts, page_lines in zip(rows["height"], rows["width"], rows["pixels"], wanted, texts, grids):
            page = _pixels(height, width, raw)
            if page is None or page_boxes is None:
                out.append(None)
                continue
            paper = np.repeat(page[:, :, None], 3, axis=2)
            for line in page_lines if page_lines is not None else []:
                _draw_line(paper, line["x0"], line["y0"], line["x1"], line["y1"], COLORS["line"])
            for i, b in enumerate(page_boxes):
                x1, y1 = min(b["x"] + b["w"], width - 1), min(b["y"] + b["h"], height - 1)
                if b["w"] and b["h"]:
                    color = COLORS[b["kind"]]
                    paper[[b["y"], y1], b["x"] : x1 + 1] = color
                    paper[b["y"] : y1 + 1, [b["x"], x1]] = color
                    if page_texts is not None and page_texts[i]:
                        _draw_label(paper, page_texts[i], b["x"] + 2, b["y"] + b["h"] - 2, 2 if b["kind"] == "move" else 1)
            out.append(png_bytes(paper))
        return pd.Series(out, dtype=object)

    draw.__annotations__ = {"rows": pd.DataFrame, "wanted": pd.Series, "texts": pd.Series, "grids": pd.Series, "return": pd.Series}
    none = F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return F.pandas_udf(draw, "binary")(image, boxes, none[0] if labels is None else labels, none[1] if lines is None else lines)


def split_preview(layout: DataFrame, image: str = "image") -> DataFrame:
    """A row a page: its columns, the numbers of moves, kazans and pits, the overlay as
    PNG, and the error where there is one."""

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("boxes"), lambda b: b["kind"] == kind)).alias(f"{kind}s")

    counts = [count(kind) for kind in ("move", "kazan", "pit")]
    kept = [c for c in layout.columns if c not in (image, "boxes", "moves", "kazans", "pits", "overlay")]
    return layout.select(*kept, *counts, overlay(F.col(image), F.col("boxes")).alias("overlay"))
