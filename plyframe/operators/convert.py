"""Requests to games: the gate, the pages of admitted requests, and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.sources import files

from . import gate, reading

KINDS = ("beam", "raw", "legal")


def convert(requests: DataFrame, scans: DataFrame, moves: reading.Runner, store: str, diagrams: reading.Runner | None = None, **options) -> DataFrame:
    """A row for each image of an admitted request and one for each refused request:
    request, n, name, error, plies, stopped, beam_pgn, raw_pgn, legal_pgn, tags, warnings.

    Everything is checked before any page is read, and pages of refused requests are
    not read at all.  A page that cannot be read is a row with its error; the others
    go on.  An image may be in one request only.
    """
    wanted = gate.admitted(requests).select("request", "n", F.col("sheet").alias("sheet"), "name", "width", "result", "tags")
    pages = scans.join(wanted.select("sheet"), "sheet", "left_semi")
    read = reading.read_pages(pages, moves, store, diagrams, wanted.select("sheet", "result", "width"), **options)
    winner = F.coalesce(F.concat(F.lit(" ("), F.col("stopped.winner"), F.lit(")")), F.lit(""))
    stopped = F.concat(F.col("stopped.reason"), winner, F.when(F.col("coarse"), " low-res").otherwise(""))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("beam_pgn").isNull(), "no such image")
    done = wanted.join(read, "sheet", "left").select("request", "n", "name", error.alias("error"), F.col("beam_plies").alias("plies"), stopped.alias("stopped"), *[f"{k}_pgn" for k in KINDS], "tags", "warnings")
    why = F.concat_ws(" ", "code", F.concat(F.lit("line "), F.col("line").cast("string")), "got")
    return done.unionByName(gate.refused(requests).select("request", why.alias("error")), allowMissingColumns=True)


def write_records(converted: DataFrame, folder: str, replace: bool = False) -> None:
    """The PGN files of each game under <request>/<name>_<kind>.pgn, committed together."""
    good = converted.filter("error is null").withColumn("file", F.concat(F.col("request").cast("string"), F.lit("/"), "name"))
    files.write_records(good, folder, name="file", kinds=KINDS, replace=replace)
