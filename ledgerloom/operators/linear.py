"""A linear text classifier whose weights are a table: trained by mini-batches, scored in the JVM.

All sums are of whole numbers, so neither the order of rows nor the number of tasks changes a weight: two runs give the
same model, and plain SQL gives the same predictions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.reports import predictions
from ledgerloom.sources import registry
from ledgerloom.sources.shared import Tables

# Words of a text that count, passes of training.
MAX_TOKENS, EPOCHS = 128, 5
#: Weights of words; a word's place is made of the first four hexadecimal digits of its MD5, so this bounds the model.
BUCKETS = 1 << 16
#: Batches that the rows of a pass are dealt into, and a word's first step against a batch's mean gradient.
BATCHES, RATE = 4, 0.3
#: Whole units of a gradient and of a logit; with these, a batch of 5e11 rows and logits up to 2e9 stay exact.
GRADIENT, LOGIT = 1 << 24, 1 << 32
#: Keeps a word's first step from a division by zero.
LEAST = 1e-8
#: What the manifest of models calls these.
KIND = "linear"
#: Places of sums that are no word's: the bias, the loss, the rows.
BIAS, LOSS, ROWS = -1, -2, -3


class Linear(NamedTuple):
    """weights (bucket int, weight double) of the words that have one, BIAS among them; loss: the mean of each pass."""

    weights: DataFrame
    loss: list[float]


def whole(c: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(c + 0.5).cast("long")


def buckets(text: Column, most: int = MAX_TOKENS) -> Column:
    """The places of a text's first words; a null text has none."""
    return F.transform(X.tokens(F.coalesce(text, F.lit("")), most), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int"))


def batch_of(key: Column, batches: int = BATCHES) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % batches


def _features(rows: DataFrame, text: str) -> DataFrame:
    """rows with _b, the words' places, and _x, what each of them counts: the root of one part in as many words."""
    return rows.withColumn("_b", buckets(F.col(text))).withColumn("_x", 1 / F.sqrt(F.greatest(F.size("_b"), F.lit(1)).cast("double")))


def _array(weights: DataFrame) -> DataFrame:
    """weights as one row: an array with a weight for each place, from BIAS on."""
    every = weights.sparkSession.range(BIAS, BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(weights, "bucket", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("w"))
    return rows.select(F.transform("w", lambda r: r["weight"]).alias("w"))


def _logits(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with _z, the logit in whole units. weights: one row of BUCKETS + 1 numbers, which goes to every task."""
    unit = lambda w, x: whole(w * x * float(LOGIT))
    add = lambda w: lambda total, b: total + unit(F.element_at(w, b + 2), F.col("_x"))
    # named once, the array becomes an argument of the one expression that reads it: no row holds a copy of it
    return rows.withColumn("_w", weights.scalar()).withColumn("_z", X.let(F.col("_w"), lambda w: F.aggregate("_b", unit(F.element_at(w, 1), F.lit(1.0)), add(w)))).drop("_w")


def probability(z: Column) -> Column:
    """Of class 1, from a logit in whole units."""
    return 1 / (1 + F.exp(-(z / float(LOGIT))))


def train(rows: DataFrame, key: str = "id", text: str = "text", label: str = "label", epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE) -> Linear | None:
    """Logistic regression on the words of rows (key, text, label of 0 or 1) by mini-batches; None without a labelled row.

    Each row is in one batch of every pass, by its key. A step scores a batch's rows, adds up their gradients by word,
    first in tasks and then by word, and moves the weights against the mean; a word's steps shrink with the squares of its
    gradients so far, so that rare words learn as fast as common ones. What comes to the driver is one number for each
    word's place, BUCKETS at most, whatever the number of rows. The features of all rows are written once.
    """
    spark = rows.sparkSession
    with Tables(spark, "linear") as kept:
        made = _features(rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(label).cast("double").alias("_y")).where("_y IS NOT NULL"), "_t")
        made = kept.save(made.select("_y", "_b", "_x", batch_of(F.col("_k"), batches).alias("_batch")), "features", by=("_batch",))
        weights, squares = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
        losses, met = [], {BIAS}
        for _ in range(epochs):
            loss = seen = 0
            for batch in range(batches):
                sums = _step(made.where(F.col("_batch") == batch), spark.createDataFrame(pa.table({"w": pa.array([weights], pa.list_(pa.float64()))})))
                n = sums.pop(ROWS, 0)
                if not n:
                    continue
                loss, seen = loss + sums.pop(LOSS), seen + n
                for b, g in sums.items():
                    mean = g / GRADIENT / n
                    squares[b + 1] += mean * mean
                    weights[b + 1] -= rate * mean / (math.sqrt(squares[b + 1]) + LEAST)
                    met.add(b)
            losses.append(loss / GRADIENT / seen if seen else 0.0)
        return Linear(as_table(spark, {b: weights[b + 1] for b in met}), losses) if seen else None


def counted(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Weights (bucket, weight) from counts: by how much more of its class's words a word is in class 1 than in class 0, as logarithms.

    One pass and two aggregates; words are counted once more than they occur, so that none has no part in a class.
    """
    rows = rows.select(buckets(F.col(text)).alias("_b"), F.col(label).alias("_y")).where("_y IS NOT NULL")
    one, none = F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)
    words = rows.select("_y", F.explode("_b").alias("bucket")).groupBy("bucket").agg(one.alias("n1"), none.alias("n0"))
    total = words.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("t1"), F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"))
    part = lambda n, t: F.log((F.col(n) + 1).cast("double") / (F.col(t) + BUCKETS).cast("double"))
    weight = F.round(part("n1", "t1") - part("n0", "t0"), 6)
    words = words.withColumn("t1", total.select("t1").scalar()).withColumn("t0", total.select("t0").scalar()).select("bucket", weight.alias("weight"))
    bias = F.round(F.log((one + 1).cast("double") / (none + 1).cast("double")), 6)
    return words.unionByName(rows.agg(bias.alias("weight")).select(F.lit(BIAS).alias("bucket"), "weight"))


def as_table(spark: SparkSession, weights: dict[int, float]) -> DataFrame:
    return spark.createDataFrame(sorted(weights.items()), "bucket int, weight double")


def _step(batch: DataFrame, weights: DataFrame) -> dict[int, int]:
    """Sums of a batch's gradients, in whole units, by word, with those of the bias, the loss and the rows."""
    rows = _logits(batch, weights).withColumn("_p", probability(F.col("_z")))
    rows = rows.withColumn("_g", whole((F.col("_p") - F.col("_y")) * F.col("_x") * float(GRADIENT)))
    own = F.when(F.col("_y") == 1, F.col("_p")).otherwise(1 - F.col("_p"))
    extra = F.array(
        F.struct(F.lit(BIAS).alias("b"), whole((F.col("_p") - F.col("_y")) * float(GRADIENT)).alias("g")),
        F.struct(F.lit(LOSS).alias("b"), whole(-F.log(F.greatest(own, F.lit(1e-12))) * float(GRADIENT)).alias("g")),
        F.struct(F.lit(ROWS).alias("b"), F.lit(1).cast("long").alias("g")),
    )
    every = rows.select(F.explode(F.concat(F.transform("_b", lambda b: F.struct(b.alias("b"), F.col("_g").alias("g"))), extra)).alias("e"))
    return {r["b"]: r["g"] for r in every.groupBy("e.b").agg(F.sum("e.g").alias("g")).collect()}


OUTPUTS = ["logits", "pred_class", "pred_label", "confidence"]


def predict(docs: DataFrame, weights: DataFrame, text: str = "text") -> DataFrame:
    """docs with logits (of both classes), pred_class, pred_label and confidence; no row is shuffled.

    Words without a weight count nothing; a null or empty text has the bias alone. Columns of docs may have any names;
    those of the outputs' names give way to them.
    """
    rows = _features(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_t")), "_t")
    rows = _logits(rows, _array(weights)).withColumn("_z", F.col("_z") / float(LOGIT))
    rows = rows.withColumn("logits", F.array(0 - F.col("_z") / 2, F.col("_z") / 2))
    return predictions(rows).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in OUTPUTS], *OUTPUTS)


def save(model: Linear, folder: str) -> str:
    """Saves the weights and losses as tables and publishes them; returns the path."""
    spark = model.weights.sparkSession

    def write(path: str) -> None:
        model.weights.coalesce(1).write.parquet(f"{path}/weights")
        spark.createDataFrame(list(enumerate(model.loss, 1)), "epoch int, loss double").coalesce(1).write.parquet(f"{path}/loss")

    return registry.publish(spark, folder, KIND, write)


def load(spark: SparkSession, path: str) -> Linear:
    """A saved model."""
    loss = spark.read.parquet(f"{path}/loss").orderBy("epoch").collect()
    return Linear(spark.read.parquet(f"{path}/weights"), [r["loss"] for r in loss])
