"""Bounded forward as-of lookups of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import HORIZON, TOLERANCE


#: Days in a block of prices. Long blocks hold fewer prices twice, short ones spread a ticker's rows over more tasks.
BLOCK = 64


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BLOCK)


def price_blocks(prices: DataFrame, reach: int) -> DataFrame:
    """(_ticker, _block, _prices): for each block of days the prices (trade_date, close) of its days and of reach days after it, one a date, the least close.

    A price is shuffled once for each block that may need it, not for each day. The number of tasks is fixed: small as
    the shuffled rows are, what they join need not be, so they are not to be merged by their size.
    """
    own = F.sequence(_block(F.date_add("trade_date", -reach)), _block(F.col("trade_date")))
    rows = prices.select(F.col("ticker").alias("_ticker"), F.explode(own).alias("_block"), "trade_date", "close")
    rows = rows.repartition(int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_ticker", "_block")
    days = rows.groupBy("_ticker", "_block", "trade_date").agg(F.min("close").alias("close"))
    return days.groupBy("_ticker", "_block").agg(F.collect_list(F.struct("trade_date", "close")).alias("_prices"))


def _with_blocks(rows: DataFrame, prices: DataFrame, day: str, ticker: str, reach: int) -> DataFrame:
    """rows with the _prices of their block, by one equality join; rows without a ticker or day, which find none, are spread over tasks."""
    nowhere = rows[ticker].isNull() | rows[day].isNull()
    at = F.when(nowhere, F.xxhash64(*rows.columns)).otherwise(_block(rows[day]))
    right = price_blocks(prices, reach).withColumnRenamed("_block", "_own")
    rows = rows.withColumn("_block", at)
    return rows.join(right, (rows[ticker] == F.col("_ticker")) & (rows["_block"] == F.col("_own")), "left").drop("_ticker", "_block", "_own")


def _first_price(since: Column, until: Column) -> Column:
    """The first of _prices from one day to another, both included; else null."""
    return F.array_min(F.filter("_prices", lambda p: (p["trade_date"] >= since) & (p["trade_date"] <= until)))


def forward_asof(rows: DataFrame, prices: DataFrame, day: str, out: str, tolerance: int, ticker: str = "ticker") -> DataFrame:
    """Adds {out}_date and {out}_close: the first price from day on, at most tolerance days later; else null."""
    found = _with_blocks(rows, prices, day, ticker, tolerance).withColumn("_p", _first_price(F.col(day), F.date_add(day, tolerance)))
    return found.withColumns({f"{out}_date": F.col("_p.trade_date"), f"{out}_close": F.col("_p.close")}).drop("_p", "_prices")


def report_prices(reports: DataFrame, prices: DataFrame, horizon: int = HORIZON, tolerance: int = TOLERANCE) -> DataFrame:
    """Reports (ticker, report_date, ...) with the price at the report and the one horizon days later, by one join.

    The base is the first price from the day on, the future one the first from horizon days later on; both lie at most
    horizon + tolerance days after the day, as one fetch of prices would.
    """
    day, end = F.col("report_date"), F.date_add("report_date", horizon + tolerance)
    found = _with_blocks(reports, prices, "report_date", "ticker", horizon + tolerance)
    found = found.withColumns({"_b": _first_price(day, end), "_f": _first_price(F.date_add(day, horizon), end)}).drop("_prices")
    told = {"base_date": "_b.trade_date", "base_close": "_b.close", "future_date": "_f.trade_date", "future_close": "_f.close"}
    return found.withColumns({k: F.col(v) for k, v in told.items()}).drop("_b", "_f")
