"""From raw report texts and prices to a labelled training set, and on to a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.numbers import to_report_date
from ledgerloom.operators import linear
from ledgerloom.operators import model as M
from ledgerloom.operators.asof import report_prices
from ledgerloom.operators.labeling import label_reports, with_returns
from ledgerloom.operators.reports import assemble_pages, extract_metadata, found_metadata
from ledgerloom.sources import fetching, report_sink
from ledgerloom.sources import listings as L
from ledgerloom.sources.shared import Tables


#: In what a text may end: all but the first carry no label.
OK, BROKEN, BARE = "ok", "error", "no metadata"
STATUSES = [OK, BARE, "bad date", "no price", "no later price", BROKEN]


def training_set(texts: DataFrame, prices: DataFrame, months_ahead: int = 0) -> DataFrame:
    """(report_id, text, label) of texts (report_id, raw_text) with a code, a real date and both prices.

    Metadata is read once a text, one join finds both prices, and texts are cleaned after it, so only rows that stay pay
    for it. months_ahead: how far the texts' dates run ahead of the prices'.
    """
    found = found_metadata(texts)
    found = found.withColumn("report_date", F.add_months(to_report_date(F.col("report_date_str")), -months_ahead)).where("report_date IS NOT NULL")
    return _cleaned(label_reports(found, prices))


def _cleaned(labelled: DataFrame) -> DataFrame:
    return labelled.select("report_id", X.clean_report(F.col("raw_text")).alias("text"), F.col("label_id").alias("label"))


def rated(texts: DataFrame, prices: DataFrame, months_ahead: int = 0) -> DataFrame:
    """All texts (report_id, raw_text) with their status and, where it is ok, their label_id; metadata is read once, one join finds both prices.

    A column error, where there is one, marks texts that couldn't be read.
    """
    rows = extract_metadata(texts)
    rows = rows.withColumn("report_date", F.add_months(to_report_date(F.col("report_date_str")), -months_ahead))
    bare = X.missing(F.col("ticker")) | X.missing(F.col("report_date_str"))
    broken = F.col("error").isNotNull() if "error" in texts.columns else F.lit(False)
    return with_returns(report_prices(rows, prices)).withColumn("status", F.when(broken, BROKEN).when(bare, BARE).otherwise(F.col("status")))


def batch_report(texts: DataFrame, prices: DataFrame, months_ahead: int = 0) -> DataFrame:
    """How many texts end in which status: no metadata, bad date, no price, no later price, ok."""
    return rated(texts, prices, months_ahead).groupBy("status").agg(F.count("*").alias("n"))


def observed_set(texts: DataFrame, prices: DataFrame, months_ahead: int = 0) -> tuple[DataFrame, Observation]:
    """training_set() of texts, and what counts their statuses as the rows go by: the pass that makes the set fills it."""
    counts = Observation("statuses")
    rows = rated(texts, prices, months_ahead).observe(counts, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return _cleaned(rows.where(F.col("status") == OK)), counts


def _trained(texts: DataFrame, prices: DataFrame, folder: str) -> tuple[str | None, dict[str, int]]:
    spark = texts.sparkSession
    with Tables(spark, "training") as kept:
        made, counts = observed_set(texts, prices)
        made = kept.save(made, "rows")
        model = M.train(made.select("text", F.col("label").cast("double").alias("label")))
        return None if model is None else M.save(model, folder), {s: n for s, n in counts.get.items() if n}


def run(texts: DataFrame, prices: DataFrame, folder: str) -> str | None:
    """Builds the training set, trains on it and saves the model; None if no row is valid."""
    return _trained(texts, prices, folder)[0]


def run_linear(texts: DataFrame, prices: DataFrame, folder: str) -> tuple[str | None, dict[str, int]]:
    """As run_folder(), from texts, with a linear model of this library's own: its path, and the statuses' counts."""
    spark = texts.sparkSession
    with Tables(spark, "training") as kept:
        made, counts = observed_set(texts, prices)
        model = linear.train(kept.save(made, "rows"), key="report_id")
        return None if model is None else linear.save(model, folder), {s: n for s, n in counts.get.items() if n}


def folder_texts(spark: SparkSession, folder: str, read: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """(report_id, raw_text, error) of a folder's report files; the path is the id, and a broken file has its error."""
    pages = L.pages_of(L.report_files(spark, folder), read)
    return assemble_pages(pages, "path", "page_no", "page_text", F.max("error").alias("error")).withColumnRenamed("path", "report_id")


def run_folder(spark: SparkSession, folder: str, prices: DataFrame, models: str, read: Callable[[bytes], list[str | None]] | None = None) -> tuple[str | None, dict[str, int]]:
    """From report files to a saved model, whose path comes back beside how many files ended in which status; files are read once."""
    return _trained(folder_texts(spark, folder, read), prices, models)


LOG = "run string, at timestamp, page long, row_idx int, title string, download_url string, path string, error string"


def crawl(spark: SparkSession, base: str, host: str, folder: str, start: int, end: int, get: Callable[[str], bytes] = L.request, get_sink: Callable[[], Callable[[str, bytes], None]] | None = None, log: str | None = None, **pace) -> DataFrame:
    """Fetches listing pages start to end, saves the reports that they link in folder, and returns (page, row_idx, title, download_url, path, error).

    A listing or report that can't be had is a row with its error. Of reports with the same title the last is saved, as
    if each had overwritten the one before. pace: per_second, lanes, tries and wait of fetching.fetch().

    What comes is written once, and all that follows reads it there, so no request is made twice, also where an executor
    is lost after it. Outcomes are appended to log, a table beside the folder: a later run leaves out reports that an
    earlier one has saved from the same URL. Nothing of it passes the driver.
    """
    log, run = log or f"{folder.rstrip('/')}_log", uuid.uuid4().hex
    saved = _saved_before(spark, log)
    with Tables(spark, "crawl") as kept:
        pages = kept.save(fetching.fetch(L.listing_urls(spark, base, start, end), get, **pace), "pages")
        links = L.report_links(pages.where("error IS NULL").select("page", F.decode("content", "UTF-8").alias("html")), host, folder)
        last = links.groupBy("path").agg(F.max_by(F.struct("page", "row_idx", "title", "download_url"), F.struct("page", "row_idx")).alias("r")).select("path", "r.*")
        known = last.join(saved, ["path", "download_url"], "left_semi").withColumn("error", F.lit(None).cast("string"))
        asked = last.join(saved, ["path", "download_url"], "left_anti").withColumnRenamed("download_url", "url")
        reports = kept.save(fetching.fetch(asked, get, **pace).withColumnRenamed("url", "download_url"), "reports")
        come = reports.where("error IS NULL")
        if get_sink is None:
            named = come.withColumn("path", F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30))
            report_sink.save(spark, named, folder)
        else:
            L.save_reports(come, get_sink)
        columns = ["page", "row_idx", "title", "download_url", "path", "error"]
        bad = pages.where("error IS NOT NULL").select("page", F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("string").alias("title"), F.col("url").alias("download_url"), F.lit(None).cast("string").alias("path"), "error")
        told = reports.select(*columns).unionByName(known.select(*columns)).unionByName(bad)
        told = told.select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.col("page").cast("long").alias("page"), *columns[1:])
        told.write.mode("append").parquet(log)
    return spark.read.schema(LOG).parquet(log).where(F.col("run") == run).drop("run", "at")


def _saved_before(spark: SparkSession, log: str) -> DataFrame:
    """(path, download_url) of what earlier runs have saved: for each path the URL that it was saved from last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, download_url string")
    rows = spark.read.schema(LOG).parquet(log).where("error IS NULL AND path IS NOT NULL")
    return rows.groupBy("path").agg(F.max_by("download_url", F.struct("at", "page", "row_idx")).alias("download_url"))
