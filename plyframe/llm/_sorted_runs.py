"""First occurrences in a range-partitioned, sorted stream.

Rows (hash words, document, place) are range-partitioned and sorted by hash,
then document and place, so that a hash that a third of all documents hold is
spread over many partitions.  Each task streams its rows once, a run of equal
hashes at a time.  Of a run that ends with the task it has the beginning, so it knows
the first document, and that the run counts once least_docs documents are seen;
of the run that it starts within it knows neither: those rows pass on undecided,
while the task before adds a row for each of least_docs documents to the sums.  The
totals of such hashes (two per task, and one per HOLD rows, at most) are counted,
and while they are as few as that makes them broadcast to the tasks that read the
rows found, once for decided and undecided ones, so that a hash of very many rows is
never dealt to one task; beyond MOST_BROADCAST the undecided ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

HOLD = 200_000
#: What a task knows of a row; SUMMED rows only add to the totals.
DECIDED, UNDECIDED, SUMMED = 0, 1, 2
#: Totals that are broadcast at most (some 40 bytes each).
MOST_BROADCAST = 200_000


def repeated(rows: DataFrame, hashes: list[str], least_docs: int, name: str, largest_first: bool = False) -> DataFrame:
    """Those rows whose hash is in at least least_docs documents, with first_doc
    (the smallest document that has it; the largest with largest_first).

    All columns are longs without nulls: the hashes, doc, ver, place and more.
    A document that is in the table several times (ver tells its texts apart)
    counts once.
    """
    order = [*hashes, F.desc("doc") if largest_first else F.asc("doc"), "ver", "place"]
    fields = rows.columns
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: np.zeros(0, np.int64) for f in fields}
        # The hash of an open run, and its first document (None: undecided).
        open_run = open_first = None
        started = False

        def starts(x: dict[str, np.ndarray]) -> np.ndarray:
            new = np.ones(len(x["doc"]), bool)
            new[1:] = np.logical_or.reduce([x[h][1:] != x[h][:-1] for h in hashes])
            return new

        def batch_of(x: dict[str, np.ndarray], first_doc: np.ndarray, state: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(x[f]) for f in fields], pa.array(first_doc), pa.array(np.full(len(first_doc), state, np.int32))], names=[*fields, "first_doc", "state"])

        def decided(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = starts(x)
            first = np.flatnonzero(new)
            other = new.copy()
            other[1:] |= x["doc"][1:] != x["doc"][:-1]
            run_of = np.cumsum(new) - 1
            pick = (np.add.reduceat(other, first, dtype=np.int64) >= least_docs)[run_of]
            if pick.any():
                yield batch_of({f: v[pick] for f, v in x.items()}, x["doc"][first][run_of][pick], DECIDED)

        def cut_off(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            """A run that may go on elsewhere: rows of DECIDED and of SUMMED, or UNDECIDED."""
            other = np.ones(len(x["doc"]), bool)
            other[1:] = x["doc"][1:] != x["doc"][:-1]
            docs = np.flatnonzero(other)[:least_docs]
            if len(docs) == least_docs:
                yield batch_of(x, np.full(len(other), x["doc"][0]), DECIDED)
                yield batch_of({f: v[docs] for f, v in x.items()}, x["doc"][docs], SUMMED)
            else:
                yield batch_of(x, x["doc"], UNDECIDED)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {f: np.concatenate([held[f], batch.column(f).to_numpy(zero_copy_only=False)]) for f in fields}
            if not started:
                started, open_run = True, tuple(x[h][0] for h in hashes)
            first = np.flatnonzero(starts(x))
            if open_run is not None:
                if tuple(x[h][0] for h in hashes) == open_run:
                    cut = first[1] if len(first) > 1 else len(x["doc"])
                    part = {f: v[:cut] for f, v in x.items()}
                    yield batch_of(part, part["doc"] if open_first is None else np.full(cut, open_first), UNDECIDED if open_first is None else DECIDED)
                    x, first = {f: v[cut:] for f, v in x.items()}, first[1:] - cut
                if len(first):
                    open_run = open_first = None
            if not len(first):
                held = x
                continue
            if first[-1]:
                yield from decided({f: v[: first[-1]] for f, v in x.items()})
            held = {f: v[first[-1] :] for f, v in x.items()}
            if len(held["doc"]) > HOLD:
                open_run = tuple(held[h][0] for h in hashes)
                for part in cut_off(held):
                    if part.column("state")[0].as_py() == DECIDED:
                        open_first = int(held["doc"][0])
                    yield part
                held = {f: v[:0] for f, v in held.items()}
        if len(held["doc"]):
            yield from cut_off(held)

    kinds = ", ".join(f"{f} long" for f in fields)
    found = written(spread.mapInArrow(run, f"{kinds}, first_doc long, state int"), name)
    edge = found.filter(F.col("state") == UNDECIDED).select(*fields)
    totals = (
        found.filter(F.col("state") != DECIDED)
        .select(*hashes, "doc")
        .distinct()
        .groupBy(*hashes)
        .agg(F.count("*").alias("n_docs"), (F.max if largest_first else F.min)("doc").alias("first_doc"))
        .filter(F.col("n_docs") >= least_docs)
    )
    totals = written(totals, f"{name}-totals")
    if totals.count() > MOST_BROADCAST:
        later = edge.join(totals, hashes).select(*fields, "first_doc")
        return found.filter(F.col("state") == DECIDED).select(*fields, "first_doc").unionByName(later)
    # One reading of all rows: what is decided stays, the others meet their totals.
    told = F.broadcast(totals.select(*[F.col(h).alias(f"_{h}") for h in hashes], F.col("first_doc").alias("_first")))
    same = [F.col(h) == F.col(f"_{h}") for h in hashes]
    rows = found.filter(F.col("state") != SUMMED).join(told, [*same, F.col("state") == UNDECIDED], "left")
    known = F.when(F.col("state") == DECIDED, F.col("first_doc")).otherwise(F.col("_first"))
    return rows.select(*fields, known.alias("first_doc")).filter("first_doc is not null")
