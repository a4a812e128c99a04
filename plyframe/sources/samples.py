"""Labelled samples as a source: row i is a function of the seed and i alone.

    spark.read.format("plyframe_samples").options(n=4000, seed=1234, classes=json).load()

gives (sample, class_idx, class).  `classes` is a JSON list, or `task` names the list
(`moves` or `diagrams`).  The draw is a digest, so the same rows come under any number
of `partitions`, and a longer source begins with the shorter one.  Without a seed, each
load draws anew.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "plyframe_samples"
BATCH = 8192


def drawn(seed: str, i: int, n_classes: int) -> int:
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % n_classes


class Range(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        super().__init__((begin, end))


class SampleReader(DataSourceReader):
    def __init__(self, n: int, seed: str, classes: list[str], parts: int) -> None:
        self.n, self.seed, self.classes, self.parts = n, seed, classes, parts

    def partitions(self) -> list[Range]:
        cuts = [self.n * k // self.parts for k in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        begin, end = partition.value
        for at in range(begin, end, BATCH):
            samples = range(at, min(at + BATCH, end))
            index = [drawn(self.seed, i, len(self.classes)) for i in samples]
            yield pa.RecordBatch.from_arrays([pa.array(samples, pa.int64()), pa.array(index, pa.int32()), pa.array([self.classes[k] for k in index])], names=["sample", "class_idx", "class"])


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "sample long, class_idx int, class string"

    def reader(self, schema: StructType) -> SampleReader:
        classes = json.loads(self.options["classes"]) if "classes" in self.options else _task(self.options.get("task", "moves"))
        if not classes:
            raise ValueError("there are no classes to draw from")
        return SampleReader(int(self.options["n"]), self.options.get("seed") or secrets.token_hex(8), classes, max(1, int(self.options.get("partitions", "8"))))


def _task(name: str) -> list[str]:
    from plyframe.operators.reading import DIAGRAM_CLASSES, MOVE_CLASSES

    return {"moves": MOVE_CLASSES, "diagrams": DIAGRAM_CLASSES}[name]


def samples(spark: SparkSession, n: int, seed: int | None = None, classes: list[str] | None = None, task: str = "moves", partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SampleSource)
    reader = spark.read.format(FORMAT).options(n=n, task=task, partitions=partitions)
    if classes is not None:
        reader = reader.option("classes", json.dumps(classes))
    return (reader if seed is None else reader.option("seed", seed)).load()
