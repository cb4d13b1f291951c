"""Report texts and report files that land in a folder, taken up as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions import text as X
from ledgerloom.operators.reports import found_metadata
from ledgerloom.sources import report_sink

SCHEMA = "report_id long, raw_text string"


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (report_id, raw_text) from Parquet files as they appear."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ready(reports: DataFrame) -> DataFrame:
    """(report_id, ticker, report_date_str, text) of reports with a code and a date; no state is kept."""
    found = found_metadata(reports)
    return found.select("report_id", "ticker", "report_date_str", X.clean_report(F.col("raw_text")).alias("text"))


def write(reports: DataFrame, folder: str, checkpoint: str):
    """Writes what is there and ends."""
    return ready(reports).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


FILES = "path string, modificationTime timestamp, length long, content binary"
_LAST, _STATE = "title string, modificationTime timestamp, path string, content binary", "at long, path string"
#: How late a file may come, by its time of change, and still be held against others of its title.
LATE = "7 days"


def landed_files(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (title, modificationTime, path, content): report files below a folder as they appear; the title is the file's name."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(X.last_segment(F.col("path")).alias("title"), "modificationTime", "path", "content")


def _newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last of a title's new files, if it is later than what was seen before; the state has its time and path alone."""
    if state.hasTimedOut:
        state.remove()
        return
    best = state.get if state.exists else None
    row = None
    for frame in frames:
        micros = frame["modificationTime"].astype("datetime64[us]").astype("int64")
        for k, own in enumerate(zip(micros.tolist(), frame["path"].tolist())):
            if best is None or own > tuple(best):
                best, row = own, frame.iloc[k : k + 1]
    if best is not None:
        state.update(tuple(best))
        # a title's state may go once no file in time can be earlier than it
        state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + 1)
    if row is not None:
        yield row[["title", "modificationTime", "path", "content"]]


def last_of_titles(files: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of each title's files as they outdo those before: of a later change, or of the same and a greater path.

    Files that are out of order, or come again, change nothing, up to late. State is kept for titles whose last file
    is within that span of the latest of all, so it doesn't grow with all titles ever seen. Files that come later than
    that are left out.
    """
    return files.withWatermark("modificationTime", late).groupBy("title").applyInPandasWithState(_newer, _LAST, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def keep_reports(spark: SparkSession, folder: str, saved: str, checkpoint: str, late: str = LATE, files_per_trigger: int = 100):
    """Keeps the last file of every title in the folder saved, as files land in folder; takes what is there and ends.

    A trigger that is done again after a failure saves the same files once more, whole, so each title ends as it would
    in one batch over all files: see last_files().
    """

    def save(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        report_sink.save(session, rows.select(F.col("title").alias("path"), "content", F.unix_micros("modificationTime").alias("page"), F.col("path").alias("row_idx")), saved)

    rows = last_of_titles(landed_files(spark, folder, files_per_trigger), late)
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def last_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the last file of every title below a folder, in one batch; path is the title."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    files = files.select(X.last_segment(F.col("path")).alias("title"), F.unix_micros("modificationTime").alias("at"), "path", "content")
    return report_sink.last_of_each(files, "title", ("at", "path"))
