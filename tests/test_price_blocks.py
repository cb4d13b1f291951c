"""Price lookups by blocks of days: what is shuffled, how rows are dealt, and the same rows as a plain search."""

import datetime as dt
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import asof
from ledgerloom.operators.labeling import label_table
from ledgerloom.plans import catalogue

at = lambda n: dt.date(1970, 1, 1) + dt.timedelta(days=n)


@contextmanager
def setting(spark, name, value):
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def shuffled_rows(node):
    """Rows that the exchanges of a plan that has run wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind == "ReusedExchangeExec":
        return 0
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    below = node.children()
    return own + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


NAMED = ["batch_status_counts", "sql_label_reports", "label_status_counts", "key_value_lines", "label_reports", "label_reports_wide", "training_set", "base_asof", "future_asof"]


@pytest.mark.parametrize("name", NAMED)
def test_shuffles_no_row_for_each_day(spark, sf_dir, name):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        made = catalogue.QUERIES[name](spark, sf_dir)
        made.collect()
    given = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert 0 < shuffled_rows(made._jdf.queryExecution().executedPlan()) <= 3 * given


def some(spark, seed=3):
    r = random.Random(seed)
    prices = [(r.choice("ab"), at(r.randint(-300, 300)), r.choice([None, 0.0, 1.5, 2.0, 7.25])) for _ in range(60)]
    reports = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *[at(n) for n in range(-330, 330)] * 2])) for i in range(500)]
    return prices, reports, spark.createDataFrame(prices, "ticker string, trade_date date, close double"), spark.createDataFrame(reports, "report_id long, ticker string, report_date date")


def first(prices, ticker, since, until):
    days = sorted({d for t, d, _ in prices if t == ticker and since <= d <= until})
    return (days[0], min((c for t, d, c in prices if t == ticker and d == days[0] and c is not None), default=None)) if days else (None, None)


@pytest.mark.parametrize(("horizon", "tolerance"), [(30, 20), (0, 0), (100, 200)])
def test_same_as_a_plain_search(spark, horizon, tolerance):
    prices, reports, p, r = some(spark)
    days = lambda n: dt.timedelta(days=n)
    got = {x["report_id"]: tuple(x)[3:] for x in asof.report_prices(r, p, horizon, tolerance).collect()}
    late = {x["report_id"]: tuple(x)[3:] for x in asof.forward_asof(r, p, "report_date", "x", tolerance).collect()}
    assert len(got) == len(late) == len(reports)
    for i, ticker, day in reports:
        none = (None, None)
        end = day and day + days(horizon + tolerance)
        assert got[i] == ((*first(prices, ticker, day, end), *first(prices, ticker, day + days(horizon), end)) if day else none * 2)
        assert late[i] == (first(prices, ticker, day, day + days(tolerance)) if day else none)


def test_rows_that_find_nothing_are_spread(spark):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        p = spark.createDataFrame([("a", at(0), 1.0)], "ticker string, trade_date date, close double")
        r = spark.range(400).select(F.col("id").alias("report_id"), F.lit(None).cast("string").alias("ticker"), F.lit(at(0)).alias("report_date"))
        dealt = label_table(r, p).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(x["count"] for x in dealt) == 400
    assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_meet_prices_in_all_tasks(spark, sf_dir):
    """Not in fewer, as their shuffled size would have it: texts are far larger in a task than in a shuffle."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        made = catalogue.QUERIES["training_set"](spark, sf_dir).select(F.spark_partition_id().alias("task")).distinct().collect()
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions"))
