"""From scanned pages to games in one call.

Pages are laid out, cut, cleaned and classified in one pass without a shuffle; the
class probabilities (no pixels) are written once and read by all that follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.text import whole_number
from plyframe.operators import images, pages, sheets
from plyframe.operators.metrics import has_ink

Runner = Callable[[], Callable[[np.ndarray], np.ndarray]]

#: The classes in the order that decoding uses, the most images of a
#: request, the width of the beam where none can be read, and the widths on offer.
MOVE_CLASSES = [f"{s}{e}{x}" for s in range(1, 10) for e in range(1, 10) for x in ("", "x")] + ["empty"]
DIAGRAM_CLASSES = [str(v) for v in range(82)] + ["x", "-", "empty"]
MOST_IMAGES, DEFAULT_WIDTH = 5, 2048
WIDTHS = [1 << k for k in range(10, 31)]


def in_order(p: Column, given: list[str], wanted: list[str]) -> Column:
    """Probabilities of a model's classes in another order; a class the model lacks has 0."""
    place = {name: i for i, name in enumerate(given)}
    at = F.array(*[F.lit(place.get(name)).cast("int") for name in wanted])
    return F.when(p.isNotNull(), F.transform(at, lambda i: F.coalesce(F.get(p, i), F.lit(0.0))))


def classified(layout: DataFrame, moves: Runner, diagrams: Runner | None = None, move_classes: list[str] = MOVE_CLASSES, diagram_classes: list[str] = DIAGRAM_CLASSES, temperature: float = 1.0, views: bool = True) -> DataFrame:
    """A row a cell: the page's columns, kind, move_no, side, pit_index, ink and p.

    p is null for cells with too little ink, which are never read, and for diagrams
    without their classifier.  A page with an error is one row without a cell.
    """
    cut = pages.fixed(pages.cells(layout, failed=True), "_clean", images.clean_cell(F.col("image")))
    cut = cut.withColumn("ink", F.col("_clean.ink_ratio"))
    picture = F.struct(*[F.col(f"_clean.{n}").alias(n) for n in ("height", "width", "pixels")])
    inky = has_ink(F.col("kind"), F.col("ink"))
    cut = cut.withColumn("_move", F.when(inky & (F.col("kind") == "move"), picture)).withColumn("_p", images.probabilities(F.col("_move"), moves, temperature, views))
    p = in_order(F.col("_p"), move_classes, MOVE_CLASSES)
    if diagrams is not None:
        cut = cut.withColumn("_board", F.when(inky & (F.col("kind") != "move"), picture)).withColumn("_q", images.probabilities(F.col("_board"), diagrams, temperature, views))
        p = F.coalesce(p, in_order(F.col("_q"), diagram_classes, DIAGRAM_CLASSES))
    return cut.withColumn("p", p).drop("image", "bbox", "_clean", "_move", "_p", "_board", "_q")


def read_pages(scans: DataFrame, moves: Runner, store: str, diagrams: Runner | None = None, results: DataFrame | None = None, width: int = DEFAULT_WIDTH, **options) -> DataFrame:
    """A row for each scan (sheet, image): what read_sheets gives, with coarse and error.

    `store` is a folder that all executors share, where the probabilities are written;
    what is there is replaced.  A scan that cannot be laid out has its error and nulls.
    Sheets are distinct.
    """
    kept = classified(pages.with_layout(scans.select("sheet", "image")), moves, diagrams, **options)
    kept.write.mode("overwrite").parquet(store)
    known = scans.sparkSession.read.parquet(store)
    cells = known.filter("kind = 'move'")
    boards = known.filter("kind <> 'move' AND p IS NOT NULL") if diagrams is not None else None
    read = sheets.read_sheets(cells, boards, results, width)
    state = known.groupBy("sheet").agg(F.any_value("coarse").alias("coarse"), F.any_value("error").alias("error"))
    return state.join(read, "sheet", "left")


def beam_width(asked: Column) -> Column:
    """The width a user typed, at least 1; 2048 where it is no whole number."""
    number = F.coalesce(whole_number(asked), F.lit(DEFAULT_WIDTH))
    return F.greatest(F.lit(1), F.least(number, F.lit((1 << 31) - 1))).cast("int")


def request_error(n_images: Column) -> Column:
    """Why a request is not begun at all, or null: no image or more than five."""
    return F.when(n_images > MOST_IMAGES, F.concat(F.lit(f"at most {MOST_IMAGES} images, got "), n_images.cast("string"))).when(F.coalesce(n_images, F.lit(0)) < 1, "no images")
