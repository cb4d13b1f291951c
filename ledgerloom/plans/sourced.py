"""Queries that read through this library's own data sources, which run in Python workers; catalogue.py has those that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import catalogue
from ledgerloom.sources import fixtures as S
from ledgerloom.sources import price_source


def price_source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """price_range through the price source: its bounds are pushed into the source's scan."""
    return price_source.prices(spark, S.price_table(spark, sf_dir), start="1993-01-01", end="1997-12-31")


QUERIES = {"price_source_range": price_source_range}
ORACLE = {"price_source_range": catalogue.ORACLE["price_range"]}
