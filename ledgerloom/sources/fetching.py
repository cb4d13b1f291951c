"""Polite fetching: requests are dealt by host, paced, and tried again where that may help."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests to a host in a second, tries of a request, seconds before the second try (twice as many before each further one).
PER_SECOND, TRIES, WAIT = 1.0, 3, 0.5


class Pace:
    """A bucket that gets a token every so often and holds one: take() waits for it."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / per_second, clock, sleep, None

    def take(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def worth_another_try(failed: Exception) -> bool:
    """Whether the failure may pass: not so where the site has said that the request is wrong."""
    code = getattr(failed, "code", None)
    return not (isinstance(code, int) and 400 <= code < 500 and code not in (408, 429))


def got(url: str, get: Callable[[str], bytes], pace: Pace, tries: int, wait: float) -> tuple[bytes | None, str | None, int]:
    """(content, error, tries made) of a request; every try waits for its token."""
    for k in range(1, tries + 1):
        pace.take()
        try:
            return get(url), None, k
        except Exception as failed:  # noqa: BLE001  whatever the connector raises belongs to this row
            if k == tries or not worth_another_try(failed):
                return None, str(failed), k
            pace.sleep(wait * 2 ** (k - 1))
    raise ValueError("a request takes a try")


def fetch(urls: DataFrame, get: Callable[[str], bytes], per_second: float = PER_SECOND, lanes: int = 1, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """urls (url, ...) with content, error and tries: a failed request leaves a row with its error, not a failed job.

    All requests to a host are one task's, so its pace holds; a host of many may be dealt into lanes, which share the
    pace. A null URL is a row with an error. Columns content, error and tries give way to these.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    kept = [c for c in urls.columns if c not in ("content", "error", "tries")]
    rows = urls.select(*kept, host.alias("_host"), F.pmod(F.xxhash64("url"), F.lit(lanes)).cast("int").alias("_lane"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces: dict[tuple, Pace] = {}
        for frame in frames:
            for at in range(len(frame)):  # one row at a time, so that what a task holds is one answer
                part = frame.iloc[at : at + 1]
                place = (part["_host"].iloc[0], part["_lane"].iloc[0])
                pace = paces.setdefault(place, Pace(per_second / lanes))
                url = part["url"].iloc[0]
                content, error, n = (None, "no URL", 0) if url is None else got(url, get, pace, tries, wait)
                yield part.drop(columns=["_host", "_lane"]).assign(content=[content], error=[error], tries=[n])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.select(*kept).schema) + ", content binary, error string, tries int"
    return rows.repartition("_host", "_lane").mapInPandas(run, schema)
