"""Saved models: each under a folder of its own, named in an append-only manifest once it is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, SCHEMA = "_manifest", "path string, kind string, saved_at long"


def publish(spark: SparkSession, base: str, kind: str, write: Callable[[str], None], prefix: str = "model_") -> str:
    """Has a model written to a new folder of base, then names it in the manifest; returns the folder.

    The folder's name has the minute and a mark of its own, so runs of the same minute both stay. The manifest has a file
    for each model, which appears whole, by a rename, and is never changed: readers see a model or don't, and what fails
    midway leaves a folder that nobody reads.
    """
    now = datetime.now(timezone.utc)
    path = f"{base.rstrip('/')}/{prefix}{now:%Y%m%d_%H%M}_{uuid.uuid4().hex[:8]}"
    write(path)
    fs, at = _fs(spark, base)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at, MANIFEST)
    fs.mkdirs(folder)
    name = f"{int(now.timestamp() * 1_000_000):020d}-{uuid.uuid4().hex}.json"
    draft, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{name}.draft", name))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"path": path, "kind": kind, "saved_at": int(now.timestamp() * 1_000_000)}).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"{final} can't be published")
    return path


def published(spark: SparkSession, base: str) -> DataFrame:
    """(path, kind, saved_at) of all models in the manifest; none if there is no manifest."""
    fs, at = _fs(spark, base)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at, MANIFEST)
    if not fs.exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.json").json(folder.toString())


def newest(spark: SparkSession, base: str) -> tuple[str, str] | None:
    """(path, kind) of the model saved last; None if none is published. Of two of one microsecond the greater path."""
    best = published(spark, base).agg(F.max(F.struct("saved_at", "path", "kind")).alias("m")).select("m.*").first()
    return None if best["path"] is None else (best["path"], best["kind"])


def _fs(spark: SparkSession, base: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
