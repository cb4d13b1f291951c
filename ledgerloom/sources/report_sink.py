"""Report files as a sink of two phases: tasks stage whole files, and only when all have ended do these get their names.

    spark.dataSource.register(ReportSink)
    rows.write.format("report_files").mode("append").option("path", "/pdf").save()      # rows: (path, content)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: a folder of files, beside a list of the names that they are to get."""

    folder: str
    files: int


class ReportSink(DataSource):
    """Rows (path, content) as files below the folder that the option path names; a row's path is relative to it."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"the sink takes columns path and content; {', '.join(sorted(missing))} not found")
        return ReportWriter(self.options["path"])


class ReportWriter(DataSourceWriter):
    """Stages below a folder of the run's own, made here; tasks that outlive a run's end find it gone and fail."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.staging = f"{self.folder}/_staging/{uuid.uuid4().hex}"
        system, at = file_system(self.staging)
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Stages a task's files; a task that fails takes back its own."""
        system, at = file_system(f"{self.staging}/{uuid.uuid4().hex}")
        names: list[str] = []
        try:
            for row in iterator:
                if not names:
                    system.create_dir(at, recursive=False)
                with system.open_output_stream(f"{at}/{len(names)}") as out:
                    out.write(bytes(row["content"]))
                names.append(checked(row["path"]))
            if names:
                with system.open_output_stream(f"{at}/names.json") as out:
                    out.write(json.dumps(names).encode())
        except BaseException:
            _gone(system, at)
            raise
        return Staged(at, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Gives all staged files their names, one task's after another's: what is held here is one task's list of names."""
        system, root = file_system(self.folder)
        for m in messages:
            if m is None or not m.files:
                continue
            with system.open_input_stream(f"{m.folder}/names.json") as f:
                names = json.loads(f.read())
            for k, name in enumerate(names):
                if "/" in name:
                    system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{m.folder}/{k}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what this run has staged, and the staging folder if no other run uses it."""
        from pyarrow import fs

        system, at = file_system(self.staging)
        _gone(system, at)
        above = at.rsplit("/", 1)[0]
        if system.get_file_info(above).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(above)):
            _gone(system, above)


def _gone(system, folder: str, tries: int = 5) -> None:
    """Removes a folder, if it is there; others may still write into it meanwhile."""
    for left in range(tries, 0, -1):
        try:
            system.delete_dir(folder)
        except FileNotFoundError:
            return
        except OSError:
            if left == 1:
                raise


def checked(path: str) -> str:
    """The path, if it stays below the folder and is no name of the sink's own."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0] == "_staging":
        raise ValueError(f"{path!r} is no path below the folder")
    return path


def file_system(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def last_of_each(reports: DataFrame, path: str = "path", order: tuple[str, ...] = ("page", "row_idx")) -> DataFrame:
    """(path, content): of rows that would be saved under one name the last, as files that overwrite each other leave it.

    The content is no part of the order and stands beside it once a row; of rows of one place the greatest content. Rows
    without a path or content take no part.
    """
    rows = reports.where(F.col(path).isNotNull() & F.col("content").isNotNull())
    return rows.groupBy(F.col(path).alias("path")).agg(F.max_by("content", F.struct(*order, F.sha2("content", 256))).alias("content"))


def save(spark: SparkSession, reports: DataFrame, folder: str) -> None:
    """Saves reports (path, content, page, row_idx) below a folder, whole and all at once; of equal paths the last."""
    spark.dataSource.register(ReportSink)
    last_of_each(reports).write.format("report_files").mode("append").option("path", folder).save()
