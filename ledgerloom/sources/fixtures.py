"""Reports, prices and texts made from the driver's tables; the oracle SQL makes the same."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import remove, shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("trade_date")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    return rows.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ticker"), "trade_date", "close")


def price_table(spark: SparkSession, sf_dir: str) -> str:
    """The path of all prices as a Parquet table in order of tickers, in the folder that executors share; made once for each state of the input."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    told = []
    for f in sorted(read(spark, sf_dir, "lineitem").inputFiles()):
        at = path(f)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        told.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    made = f"{shared_dir(spark)}/ledgerloom/prices-{hashlib.md5(chr(10).join(told).encode()).hexdigest()}"
    if not fs.exists(path(f"{made}/_SUCCESS")):
        draft = f"{made}.{uuid.uuid4().hex}"
        prices(spark, sf_dir).repartitionByRange("ticker").sortWithinPartitions("ticker", "trade_date").write.parquet(draft)
        if fs.exists(path(made)) or not fs.rename(path(draft), path(made)):  # another run was first
            remove(spark, draft)
    return made


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.lpad((F.col("o_custkey") % 100).cast("string"), 6, "0").alias("ticker"), F.col("o_orderdate").cast("date").alias("report_date"))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, raw_text): a code, a date 300 months later in one of three forms, and all that cleaning takes out."""
    o = read(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.add_months(F.col("o_orderdate").cast("date"), 300)
    form = F.when(key % 3 == 0, F.date_format(day, "yyyy.MM.dd")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MMM dd, yyyy"))
    code = F.when(key % 11 == 0, F.lit("없음")).otherwise(F.concat(F.lit("A"), F.lpad((F.col("o_custkey") % 100).cast("string"), 6, "0")))
    text = F.concat(
        F.lit("기업분석 ("), code, F.lit(")\n"), form, F.lit("\n문의 analyst"), (key % 7).cast("string"), F.lit("@broker.example 전화 02-"),
        F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((key * 7 % 10000).cast("string"), 4, "0"),
        F.lit(". \nB u y the dip 목표주가 "), (key % 900 + 100).cast("string"), F.lit(",500원 현재주가 9800원 상승여력 12.5% KOSPI 2,650.10pt 시가총액 3조 2천만원 발행주식수 1200만주 "),
        F.lit("액면가 500원 자본금 45억원 매수 (유지) Stock Data  실적은\n견조하다.\n2024.05.29 종목 123456 전망  밝다.\n60일 평균거래 12만주 끝"),
    )
    return o.select(key.alias("report_id"), text.alias("raw_text"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("logits"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("models/"), "event_type", F.lit("_"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified_at"), (F.col("event_id") % 3 != 0).alias("is_dir"))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, page_text) of conversations, some pages null, some empty."""
    text = F.when(F.col("turn") % 5 == 3, F.lit(None)).when(F.col("turn") % 7 == 4, F.lit("")).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), text.alias("page_text"))
