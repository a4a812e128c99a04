"""A sink of files that appear when the job commits, and not before.

Each task writes into a folder of its own beside the target; only the folders of the
attempts that Spark counts are moved, by rename, when all tasks are done.  A task that
is killed or run twice leaves nothing, a failed job leaves nothing, and two rows of
one name are an error that leaves nothing.  (What a task writes that outlives its
failed job lies in a folder whose name begins with a dot.)  The target is a folder
that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "plyframe_folder"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool) -> None:
        self.path, self.replace = path, replace
        self.pending = os.path.join(path, f".pending-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, n = os.path.join(self.pending, uuid.uuid4().hex), 0
        os.makedirs(folder)
        try:
            for name, content in iterator:
                if content is None:
                    continue
                target = os.path.normpath(os.path.join(folder, name))
                if not target.startswith(folder + os.sep):
                    raise ValueError(f"{name!r} is no name of a file in the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "xb") as out:  # a name that repeats in the task is an error
                    out.write(content)
                n += 1
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        moves: dict[str, str] = {}
        for message in filter(None, messages):
            for base, _, names in os.walk(message.folder):
                for name in names:
                    source = os.path.join(base, name)
                    target = os.path.join(self.path, os.path.relpath(source, message.folder))
                    if target in moves:
                        raise ValueError(f"two rows have the name {os.path.relpath(target, self.path)}")
                    if not self.replace and os.path.exists(target):
                        raise FileExistsError(target)
                    moves[target] = source
        for target, source in moves.items():
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(source, target)
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class FolderSink(DataSource):
    """df.write.format(FORMAT).option("path", folder) for rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        path = os.path.abspath(self.options["path"].removeprefix("file://"))
        return FolderWriter(path, self.options.get("replace", "false") == "true")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", replace: bool = False) -> None:
    """A file for each row whose content (text or bytes) is not null.  A file that is
    there already is an error unless `replace`, then it is replaced."""
    rows.sparkSession.dataSource.register(FolderSink)
    data = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    data.write.format(FORMAT).option("path", folder).option("replace", str(replace).lower()).mode("append").save()
