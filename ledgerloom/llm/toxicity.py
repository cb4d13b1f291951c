"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, UPPER, arrow_schema, bound_batches, or_empty, rows_of, word_hashes, PLACES, finish

#: Weights are kept for 2**BITS hashed features.
BITS = 20
#: Labelled rows that the classifier learns from at most; below that, all. They are the first by a hash of doc_id.
TRAIN_ROWS = 16_000
#: Features of all of them together at most: rows beyond that, in the same order, are not learned from.
TRAIN_FEATURES = 1 << 25
#: Passes over the training rows.
EPOCHS = 6
#: Every HELD_OUT-th row by crc32 of its doc_id is never learned from.
HELD_OUT = 5
_TRAIN = "doc_id long, at long, toxic int, features binary"
#: Bytes of a text as words: A-Z in lower case, other ASCII than letters and digits as blanks.
_WORDS = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties: each weight's step shrinks with the gradients it has seen; l1 keeps rare ones at zero."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: words, neighbouring pairs, and pairs with one or two words between."""
    h = word_hashes(text.encode().translate(_WORDS).split())
    found = [finish(h)]
    for skip in (1, 2, 3):
        if len(h) > skip:
            found.append(finish(h[:-skip] * PLACES[0] + h[skip:] * PLACES[skip]))
    return np.unique((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.uint32))


def train(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, rule: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, their weights, bias) from (label, features) rows, in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, seen = 0.0, 0.0
    positives = sum(y for y, _ in rows)
    if not 0 < positives < len(rows):  # nothing to tell apart: the share of toxic rows, kept off 0 and 1
        rate = (positives + 0.5) / (len(rows) + 1.0) if rows else 0.0
        return np.empty(0, np.int64), np.empty(0), float(np.log(max(rate, 1e-6) / (1 - min(rate, 1 - 1e-6))))
    bias = float(np.log(positives / (len(rows) - positives)))
    for _ in range(epochs):
        for y, f in rows:
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= rule.l1, 0.0, -(zf - np.sign(zf) * rule.l1) / ((rule.beta + np.sqrt(nf)) / rule.alpha + rule.l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            grown = nf + g * g
            z[f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / rule.alpha * w
            n[f] = grown
            seen += g * g
            bias -= g * 0.1 / (1.0 + np.sqrt(seen))
    w = np.where(np.abs(z) <= rule.l1, 0.0, -(z - np.sign(z) * rule.l1) / ((rule.beta + np.sqrt(n)) / rule.alpha + rule.l2))
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_TRAIN)
    for ids, at, toxic, texts in rows_of(batches, "doc_id", "at", "toxic", "text", rows=512):
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "at": at, "toxic": toxic, "features": [features(t).tobytes() for t in texts]}, schema=schema)


_MODEL = "place array<long>, weight array<double>, bias double"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for ys, fs in rows_of(batches, "toxic", "features", rows=64):
        for y, f in zip(ys, fs):
            size += len(f) // 4
            if size <= TRAIN_FEATURES:
                rows.append((y, np.frombuffer(f, np.uint32)))
    place, weight, bias = train(rows)
    yield pa.RecordBatch.from_pydict({"place": [place.tolist()], "weight": [weight.tolist()], "bias": [bias]}, schema=arrow_schema(_MODEL))


def held_out(doc_id: Column, parts: int = HELD_OUT) -> Column:
    """Whether crc32 of the id's decimal text is divisible; a null id counts as empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from labelled rows that are not held out, train_rows of them and TRAIN_FEATURES of their features at most.

    A doc_id with several labels counts as toxic if one of them says so; labels that are null or without a document
    teach nothing. Of the rows that share a doc_id one teaches, that with the least features as bytes. The ids, bounded
    by train_rows, are broadcast, so texts are never shuffled; what the training task holds is bounded by both figures.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("doc_id"))
    marked = marked.orderBy("at", "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text")).join(F.broadcast(marked), "doc_id")
    rows = rows.select("doc_id", "at", "toxic", "text").mapInArrow(_featurize, _TRAIN)
    rows = rows.groupBy("at", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("features").alias("features"))
    model = rows.coalesce(1).sortWithinPartitions("at", "doc_id").mapInArrow(_learn, _MODEL).first()
    if model is None:
        return train([])
    return np.array(model["place"], np.int64), np.array(model["weight"], float), model["bias"]


def _score(weights: tuple[np.ndarray, np.ndarray, float], columns: list[str], schema: pa.Schema):
    place, weight, bias = weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[place] = weight
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    total = bias + table[features(text or "")].sum()
                    own.append(float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))))
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.float64())], schema=schema)

    return score


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A toxicity score from 0 to 1 for every whole text, beside the columns of keep.

    The score takes the text alone. A null text is empty and gets the score of no features; without labels of both
    classes all rows get one score, the share of toxic labels. Very long texts are scored whole; repeated rows are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    fields = [f for f in rows.schema.fields if f.name in keep]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    names = [f.name for f in fields]
    source = rows.select(*dict.fromkeys([*names, "text"]))
    return source.mapInArrow(_score(fit(docs, labels, train_rows), names, to_arrow_schema(out)), out)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5)."""
    out = scored(docs, labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
