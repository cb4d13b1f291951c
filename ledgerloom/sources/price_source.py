"""Prices as a data source: parted by ranges of tickers, with bounds on ticker and date taken from the query's filters.

    spark.dataSource.register(PriceSource)
    spark.read.format("prices").option("path", "/prices").load().where("ticker = '000660' AND trade_date >= '2024-01-02'")
    spark.read.format("prices").option("connector", "my.module:daily").option("tickers", "000660,005930").load()
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ledgerloom.sources.listings import within

SCHEMA = "ticker string, trade_date date, close double"
#: Rows of a Parquet table that one range holds, about, and tickers that one task asks a connector for.
RANGE_ROWS, RANGE_TICKERS = 2_000_000, 50
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes the format known. Spark pushes filters into sources of this kind only where the session says so; it is told to, unless it has been told otherwise."""
    spark.dataSource.register(PriceSource)
    if spark.conf.get(_PUSHDOWN, None) in (None, "false"):
        spark.conf.set(_PUSHDOWN, "true")


def prices(spark: SparkSession, path: str, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """As listings.prices(), through the source."""
    register(spark)
    return within(spark.read.format("prices").option("path", path).load(), ticker, start, end)


@dataclass
class Bounds:
    """What a query asks for: all unset means all. Dates are both included; tickers: the only ones."""

    tickers: set[str] | None = None
    low: str | None = None
    high: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None

    def take(self, f: Filter) -> bool:
        """Narrows the bounds by a filter; false if it isn't one that they can express."""
        name = getattr(f, "attribute", None)
        if name == ("ticker",):
            if isinstance(f, EqualTo):
                self._only({f.value})
            elif isinstance(f, In):
                self._only(set(f.value))
            elif isinstance(f, GreaterThanOrEqual):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.high = f.value if self.high is None else min(self.high, f.value)
            else:
                return isinstance(f, IsNotNull)
            return True
        if name == ("trade_date",):
            day = dt.timedelta(days=1)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                at = f.value + day if isinstance(f, GreaterThan) else f.value
                self.start = at if self.start is None else max(self.start, at)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                at = f.value - day if isinstance(f, LessThan) else f.value
                self.end = at if self.end is None else min(self.end, at)
            return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))
        return False

    def _only(self, tickers: set[str]) -> None:
        self.tickers = tickers if self.tickers is None else self.tickers & tickers

    def wants(self, ticker: str) -> bool:
        return (self.tickers is None or ticker in self.tickers) and (self.low is None or ticker >= self.low) and (self.high is None or ticker <= self.high)

    def empty(self) -> bool:
        return self.tickers == set() or (self.start is not None and self.end is not None and self.start > self.end)


@dataclass
class TickerRange(InputPartition):
    """Tickers from first on, and before the next range's; tickers: these alone, for a connector."""

    first: str | None = None
    before: str | None = None
    tickers: list[str] = field(default_factory=list)


class PriceSource(DataSource):
    """Prices (ticker, trade_date, close), out of a folder of Parquet files (path), or of a connector: a function
    get(ticker, start, end) -> [(date, close), ...] named as module:function, and the tickers that it knows."""

    @classmethod
    def name(cls) -> str:
        return "prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PriceReader(dict(self.options))


class PriceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if ("path" in options) == ("connector" in options):
            raise ValueError("the format takes a path or a connector")
        self.options, self.bounds = options, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[TickerRange]:
        if self.bounds.empty():
            return []
        if "connector" in self.options:
            known = sorted(t for t in {t.strip() for t in self.options.get("tickers", "").split(",")} if t and self.bounds.wants(t))
            each = int(self.options.get("range", RANGE_TICKERS))
            return [TickerRange(tickers=known[k : k + each]) for k in range(0, len(known), each)]
        return [r for r in self._ranges() if self._may_hold(r)]

    def _ranges(self) -> list[TickerRange]:
        """Ranges of about RANGE_ROWS rows each, cut where row groups begin by the files' own statistics."""
        groups = []
        for fragment in _table(self.options["path"]).get_fragments():
            for g in fragment.row_groups:
                told = (g.statistics or {}).get("ticker") or {}
                groups.append((told.get("min"), g.num_rows))
        cuts, rows, each = [], 0, int(self.options.get("range", RANGE_ROWS))
        for first, n in sorted((f, n) for f, n in groups if f is not None):
            if rows >= each and (not cuts or first > cuts[-1]):
                cuts.append(first)
                rows = 0
            rows += n
        return [TickerRange(a, b) for a, b in zip([None, *cuts], [*cuts, None])]

    def _may_hold(self, r: TickerRange) -> bool:
        b = self.bounds
        inside = lambda t: (r.first is None or t >= r.first) and (r.before is None or t < r.before)
        if b.tickers is not None and not any(map(inside, b.tickers)):
            return False
        return not (b.low is not None and r.before is not None and r.before <= b.low) and not (b.high is not None and r.first is not None and r.first > b.high)

    def read(self, partition: TickerRange) -> Iterator[pa.RecordBatch]:
        yield from self._asked(partition) if "connector" in self.options else self._scanned(partition)

    def _asked(self, partition: TickerRange) -> Iterator[pa.RecordBatch]:
        module, _, name = self.options["connector"].partition(":")
        get = getattr(importlib.import_module(module), name)
        for ticker in partition.tickers:
            rows = [(d, c) for d, c in get(ticker, self.bounds.start, self.bounds.end) if (self.bounds.start is None or d >= self.bounds.start) and (self.bounds.end is None or d <= self.bounds.end)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(rows)), pa.array([d for d, _ in rows], pa.date32()), pa.array([c for _, c in rows], pa.float64())], names=["ticker", "trade_date", "close"])

    def _scanned(self, partition: TickerRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        b, ticker, day = self.bounds, ds.field("ticker"), ds.field("trade_date")
        tests = [ticker.is_valid(), day.is_valid()]
        tests += [ticker.isin(sorted(b.tickers))] if b.tickers is not None else []
        tests += [ticker >= x for x in (partition.first, b.low) if x is not None]
        tests += [ticker < partition.before] if partition.before is not None else []
        tests += [ticker <= b.high] if b.high is not None else []
        tests += [day >= pa.scalar(b.start, pa.date32())] if b.start is not None else []
        tests += [day <= pa.scalar(b.end, pa.date32())] if b.end is not None else []
        every = tests[0]
        for t in tests[1:]:
            every = every & t
        wanted = pa.schema([("ticker", pa.string()), ("trade_date", pa.date32()), ("close", pa.float64())])
        for batch in _table(self.options["path"]).to_batches(columns=wanted.names, filter=every):
            if batch.num_rows:
                yield batch.cast(wanted)


def _table(path: str):
    """The Parquet files of a folder, on any file system that Arrow opens."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return ds.dataset(at, filesystem=system, format="parquet", exclude_invalid_files=False)
