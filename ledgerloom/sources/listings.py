"""Listing pages and the report files that they link."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import html as H
from ledgerloom.functions import text as X


# Fixed value: how requests name their client.
USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"


def request(url: str, timeout: float = 60) -> bytes:
    """The body that a GET of the URL gives."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=timeout) as answer:
        return answer.read()


def file_sink() -> Callable[[str, bytes], None]:
    """Writes files, local ones or by their URI; a file appears under its name only once it is whole."""
    import os
    import uuid

    from pyarrow import fs

    def put(path: str, content: bytes) -> None:
        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
        system.create_dir(os.path.dirname(at), recursive=True)
        draft = f"{at}.{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as f:
            f.write(content)
        system.move(draft, at)

    return put


def listing_urls(spark: SparkSession, base: str, start: int, end: int) -> DataFrame:
    """(page, url) of pages start to end, both included; none if start is beyond end."""
    return spark.range(start, max(start, end + 1)).select(F.col("id").alias("page"), X.listing_url(base, F.col("id")).alias("url"))


def fetch(urls: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """urls with content and error: a failed request leaves a row with its error, not a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for url in frame["url"]:
                try:
                    got.append((get(url), None))
                except Exception as failed:  # noqa: BLE001  whatever the connector raises belongs to this row
                    got.append((None, str(failed)))
            yield frame.assign(content=[c for c, _ in got], error=[e for _, e in got])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema) + ", content binary, error string"
    return urls.mapInPandas(run, schema)


def report_links(pages: DataFrame, host: str, folder: str) -> DataFrame:
    """(page, row_idx, title, href, download_url, path) of listing pages (page, html)."""
    rows = pages.select("page", F.posexplode(H.select_links(F.col("html"))).alias("row_idx", "link"))
    title = X.file_title(F.col("link.title"))
    return rows.select("page", "row_idx", title.alias("title"), F.col("link.href").alias("href"), X.resolve_link(F.col("link.href"), host).alias("download_url"), X.file_path(folder, title).alias("path"))


def save_reports(reports: DataFrame, get_sink: Callable[[], Callable[[str, bytes], None]]) -> None:
    """Writes (path, content); the sink is made once in each task. Paths must be unique: see dedup_titles()."""

    def run(rows) -> None:
        put = get_sink()
        for r in rows:
            put(r["path"], bytes(r["content"]))

    reports.select("path", "content").foreachPartition(run)


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder whose names end in .pdf, case-sensitive and not below it: path, modificationTime, length, content. Spark leaves out files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    return files.withColumn("name", X.last_segment(F.col("path")))


def pages_of(files: DataFrame, read: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """(path, page_no, page_text, error) of report files; read turns a file into its pages' texts."""

    def default(content: bytes) -> list[str | None]:
        import io

        import pdfplumber  # only where it is installed

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [page.extract_text() for page in pdf.pages]

    parse = read or default

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(parse(bytes(content)))]
                except Exception as failed:  # noqa: BLE001  a broken file is a row with its error
                    rows.append((path, None, None, str(failed)))
            out = pd.DataFrame(rows, columns=["path", "page_no", "page_text", "error"])
            out["page_no"] = out["page_no"].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, page_text string, error string")


def model_folders(spark: SparkSession, base: str) -> DataFrame:
    """(path, modified_at, is_dir) of what lies in a folder, through Spark's file system; names that begin with _ or . are no models."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    rows = [(f.getPath().toString(), f.getModificationTime() / 1000.0, f.isDirectory()) for f in found if f.getPath().getName()[:1] not in "_."]
    df = spark.createDataFrame(rows, "path string, at double, is_dir boolean")
    return df.select("path", F.timestamp_seconds("at").alias("modified_at"), "is_dir")


def single_text(spark: SparkSession, text: str) -> DataFrame:
    """One text, as a form gives it; no row if it is blank."""
    return spark.createDataFrame([(text,)], "text string").where(~X.is_blank(F.col("text")))


def asked_texts(spark: SparkSession, texts: DataFrame, condition: str, **fields) -> DataFrame:
    """Rows of texts that meet an SQL condition whose :names are a form's fields, those with a blank text left out.

    The fields are arguments of the query and never part of its text.
    """
    return spark.sql(f"SELECT * FROM {{texts}} WHERE {condition}", args=fields, texts=texts).where(~X.is_blank(F.col("text")))


def prices(spark: SparkSession, path: str, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Prices (ticker, trade_date, close) of a Parquet table; the bounds reach its scan. Other sources: see price_source."""
    return within(spark.read.parquet(path).select("ticker", "trade_date", "close"), ticker, start, end)


def within(df: DataFrame, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Prices of a ticker, from a date on and up to one, both included."""
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if start is not None:
        df = df.where(F.col("trade_date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.to_date(F.lit(end)))
    return df
