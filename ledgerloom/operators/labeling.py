"""Labels from prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.operators.asof import report_prices

# What the prototype says in place of a label.
NO_PRICES, NO_LATER_PRICE = "데이터를 불러올 수 없습니다.", "N일 후의 데이터가 아직 없습니다."


def with_returns(priced: DataFrame) -> DataFrame:
    """Adds status, return_pct (unrounded) and label_id. With a base price of 0 or a price row without a close the return is null and the label 0."""
    status = F.when(F.col("report_date").isNull(), "bad date").when(F.col("base_date").isNull(), "no price").when(F.col("future_date").isNull(), "no later price").otherwise("ok")
    pct = N.return_pct(F.col("base_close"), F.col("future_close"))
    return priced.withColumn("status", status).withColumn("return_pct", pct).withColumn("label_id", F.when(F.col("status") == "ok", N.label_id(pct)))


def label_reports(reports: DataFrame, prices: DataFrame, horizon: int = N.HORIZON, tolerance: int = N.TOLERANCE) -> DataFrame:
    """Reports with both prices, their rounded return and label."""
    out = with_returns(report_prices(reports, prices, horizon, tolerance)).where("status = 'ok'")
    return out.withColumn("return_pct", N.shown(F.col("return_pct"))).drop("status")


def label_table(reports: DataFrame, prices: DataFrame, horizon: int = N.HORIZON, tolerance: int = N.TOLERANCE) -> DataFrame:
    """The prototype's table: dates and label as texts, and a status in place of its error texts. All reports stay."""
    out = with_returns(report_prices(reports, prices, horizon, tolerance))
    ok = F.col("status") == "ok"
    told = lambda c: F.when(ok, c)
    return out.select(
        "report_id", told(F.date_format("base_date", "yyyy-MM-dd")).alias("base_date"), told(F.col("base_close")).alias("base_close"),
        told(F.date_format("future_date", "yyyy-MM-dd")).alias("future_date"), told(F.col("future_close")).alias("future_close"),
        told(N.shown(F.col("return_pct"))).alias("return_pct"), told(N.class_text(F.col("label_id"), N.PROTOTYPE_TEXTS)).alias("label_text"),
        F.when(F.col("status") == "no later price", NO_LATER_PRICE).when(~ok, NO_PRICES).otherwise("ok").alias("status"),
    )


def status_counts(reports: DataFrame, prices: DataFrame) -> DataFrame:
    return with_returns(report_prices(reports, prices)).groupBy("status").agg(F.count("*").alias("n"))
