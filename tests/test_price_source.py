"""The price source and the report sink."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from ledgerloom.sources import fixtures as S
from ledgerloom.sources import price_source as P
from ledgerloom.sources import report_sink as RS

DAY = dt.date(2024, 1, 2)


#: A connector that gives more than it is asked for.
DAILY = """
import datetime as dt
import time
def daily(ticker, start, end):
    return [] if ticker == "000002" else [(dt.date(2024, 1, 2) + dt.timedelta(days=k), float(k)) for k in range(10)]
"""


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def path(spark):
    return S.price_table(spark, "/root/testdata/sf0.001")


def test_filters_reach_the_scan(spark, path, sf_dir):
    every = [tuple(r) for r in S.prices(spark, sf_dir).collect()]
    df = P.prices(spark, path).where((F.col("ticker").isin("000003", "000007", "x")) & (F.col("trade_date") > "1995-03-01") & (F.col("trade_date") < "1996-01-01") & (F.col("close") > 1000))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(r for r in every if r[0] in ("000003", "000007") and dt.date(1995, 3, 1) < r[1] < dt.date(1996, 1, 1) and r[2] > 1000) != []
    told = plan(df)
    assert "BatchScan prices" in told and "In(ticker" in told and "GreaterThan(trade_date,1995-03-01)" in told
    left = [line for line in told.split("\n") if line.startswith("Condition")]
    assert len(left) == 1 and "close" in left[0] and "ticker" not in left[0] and "trade_date" not in left[0]


def test_query_is_its_sql(spark, sf_dir):
    import duckdb

    from ledgerloom.plans import sourced

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    got = sourced.price_source_range(spark, sf_dir)
    assert "BatchScan prices" in plan(got) and "GreaterThanOrEqual(trade_date,1993-01-01)" in plan(got)
    want = con.sql(sourced.ORACLE["price_source_range"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_partitions_are_ranges_of_tickers(spark, sf_dir, tmp_path):
    path = str(tmp_path / "prices")
    S.prices(spark, sf_dir).repartitionByRange(5, "ticker").sortWithinPartitions("ticker").write.parquet(path)
    reader = P.PriceReader({"path": path, "range": "500"})
    ranges = reader.partitions()
    assert len(ranges) > 1 and ranges[0].first is None and ranges[-1].before is None and all(a.before == b.first for a, b in zip(ranges, ranges[1:]))
    seen = [set(t for b in reader.read(r) for t in b.column(0).to_pylist()) for r in ranges]
    assert set().union(*seen) == {r["ticker"] for r in S.prices(spark, sf_dir).select("ticker").distinct().collect()}
    assert sum(map(len, seen)) == len(set().union(*seen))  # no ticker is in two ranges
    one = P.PriceReader({"path": path, "range": "500"})
    assert list(one.pushFilters([EqualTo(("ticker",), "000004")])) == [] and len(one.partitions()) < len(ranges)


def test_a_connector_is_asked_for_what_is_wanted(spark, tmp_path):
    P.register(spark)
    (tmp_path / "daily_prices.py").write_text(DAILY)
    spark.sparkContext.addPyFile(str(tmp_path / "daily_prices.py"))
    df = spark.read.format("prices").option("connector", "daily_prices:daily").option("tickers", "000001, 000002,000003").option("range", "1").load()
    assert df.count() == 20 and df.rdd.getNumPartitions() == 3
    got = df.where("ticker >= '000002' AND trade_date BETWEEN DATE '2024-01-04' AND DATE '2024-01-05'").collect()
    assert [(r["ticker"], r["trade_date"].day) for r in got] == [("000003", 4), ("000003", 5)]


def test_bounds():
    b = P.Bounds()
    taken = [GreaterThanOrEqual(("ticker",), "b"), LessThanOrEqual(("ticker",), "y"), In(("ticker",), ("a", "b", "c")), IsNotNull(("ticker",)), GreaterThan(("trade_date",), DAY), LessThan(("trade_date",), DAY + dt.timedelta(days=5))]
    assert all(map(b.take, taken)) and (b.start, b.end) == (DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=4))
    assert b.wants("b") and not b.wants("a") and not b.wants("d")
    assert not b.take(StringStartsWith(("ticker",), "b")) and not b.take(EqualTo(("close",), 1.0)) and not b.take(GreaterThan(("ticker",), "b"))
    assert b.take(EqualTo(("trade_date",), DAY)) and b.empty()
    with pytest.raises(ValueError, match="path or a connector"):
        P.PriceReader({})


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], P.SCHEMA).write.parquet(str(tmp_path / "p"))
    assert P.prices(spark, str(tmp_path / "p"), "000001").collect() == []


def test_the_table_is_made_once(spark, path, sf_dir):
    assert S.price_table(spark, sf_dir) == path


def files(folder):
    return {} if not folder.exists() else {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_reports_are_saved_whole_and_the_last_wins(spark, tmp_path):
    rows = [("a.pdf", b"1", 1, 0), ("a.pdf", b"3", 2, 1), ("a.pdf", b"2", 2, 0), ("sub/b.pdf", b"", 1, 5), (None, b"x", 1, 1), ("c.pdf", None, 1, 1)] + [(f"m{k}.pdf", b"%d" % k, 1, k) for k in range(50)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), x, y) for p, c, x, y in rows], "path string, content binary, page int, row_idx int").repartition(4)
    folder = tmp_path / "out"
    RS.save(spark, df, str(folder))
    want = {"a.pdf": b"3", "sub/b.pdf": b""} | {f"m{k}.pdf": b"%d" % k for k in range(50)}
    assert files(folder) == want
    RS.save(spark, df.where("path = 'a.pdf' AND page = 1"), f"file://{folder}")
    assert files(folder) == want | {"a.pdf": b"1"} and not (folder / "_staging").exists()
    RS.save(spark, df.limit(0), str(folder))
    assert files(folder) == want | {"a.pdf": b"1"}


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    """One of four tasks fails after it has staged files of its own, as do its retries; other tasks have ended."""
    folder = tmp_path / "out"
    spark.dataSource.register(RS.ReportSink)

    def break_(c):
        if c == b"bad":
            raise OSError("lost")
        return c

    broken = F.udf(break_, "binary")
    rows = [(f"{k}.pdf", bytearray(b"bad" if k == 37 else b"x" * 1000)) for k in range(40)]
    df = spark.createDataFrame(rows, "path string, content binary").repartitionByRange(4, "path")
    with pytest.raises(Exception, match="lost"):
        df.select("path", broken("content").alias("content")).write.format("report_files").mode("append").option("path", str(folder)).save()
    assert not any(n.endswith(".pdf") for n in files(folder))
    until = time.time() + 20  # tasks that were running when the run ended fail as they find their folder gone
    while files(folder) and time.time() < until:
        time.sleep(0.2)
    assert files(folder) == {}
    with pytest.raises(Exception, match="no path below the folder"):
        spark.createDataFrame([("ok.pdf", bytearray(b"1")), ("../up.pdf", bytearray(b"1"))], "path string, content binary").coalesce(1).write.format("report_files").mode("append").option("path", str(folder)).save()
    assert files(folder) == {}


def test_a_task_takes_back_what_it_has_staged(tmp_path):
    writer = RS.ReportWriter(str(tmp_path / "out"))

    def rows():
        yield {"path": "a.pdf", "content": b"1"}
        assert len(files(tmp_path / "out")) == 1
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(rows())
    assert files(tmp_path / "out") == {}
    done = writer.write(iter([{"path": "a.pdf", "content": b"1"}]))
    writer.abort([done, None])
    assert files(tmp_path / "out") == {}
