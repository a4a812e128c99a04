"""Grouped statistics and page geometry as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def border_median(image: str, side: int = 8) -> str:
    """Median of a square image's edges, corners counted twice, as an integer."""
    last = side - 1
    edges = f"filter(sequence(0, {side * side - 1}), i -> i div {side} in (0, {last})), filter(sequence(0, {side * side - 1}), i -> i % {side} in (0, {last}))"
    n = 4 * side
    return f"element_at(transform(array(array_sort(transform(concat({edges}), i -> {image}[i]))), s -> int((s[{n // 2 - 1}] + s[{n // 2}]) / 2D)), 1)"


def tight_bbox(image: str, least: float, side: int = 8) -> str:
    """struct<x0, y0, x1, y1> of the cells above least (ends exclusive), or null."""
    on = f"filter(sequence(0, {side * side - 1}), i -> {image}[i] > {least}D)"
    x, y = f"transform(o, i -> i % {side})", f"transform(o, i -> i div {side})"
    return f"element_at(transform(array({on}), o -> if(size(o) = 0, null, named_struct('x0', array_min({x}), 'y0', array_min({y}), 'x1', array_max({x}) + 1, 'y1', array_max({y}) + 1))), 1)"


def ink_ratio(image: str, height: int, width: int, dark: int) -> str:
    """Share of pixels darker than `dark` off the margins.  Top and left margins are
    the floor of h/8 and w/12, bottom and right ones the ceiling."""
    top, left, bottom, right = height // 8, width // 12, -(-height // 8), -(-width // 12)
    inside = f"i div {width} >= {top} and i div {width} < {height - bottom} and i % {width} >= {left} and i % {width} < {width - right}"
    return f"size(filter(sequence(0, {height * width - 1}), i -> {inside} and {image}[i] < {dark})) / {height * width}D"


#: Fixed values of the ink filter, by kind of cell.
INK = {"kazan": 0.028, "pit": 0.02, "move": 0.02}


def has_ink(kind: Column, ink: Column) -> Column:
    return ink >= F.when(kind == "kazan", F.lit(INK["kazan"])).otherwise(F.lit(INK["pit"]))
