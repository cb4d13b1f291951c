"""A text classifier with the contract text -> (label, confidence)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.operators import linear
from ledgerloom.operators.reports import latest_model
from ledgerloom.sources import registry
from ledgerloom.sources.listings import model_folders

# Words of a text that count, passes of training, batch size of the original training (Spark ML has none).
MAX_TOKENS, EPOCHS = 128, 5
#: What the manifest of models calls these.
KIND = "pipeline"


def pipeline(features: int = 1 << 16) -> Pipeline:
    words = SQLTransformer(statement=f"SELECT *, slice(filter(split(text, '\\\\s+'), t -> t <> ''), 1, {MAX_TOKENS}) AS tokens FROM __THIS__")
    return Pipeline(stages=[words, HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=EPOCHS)])


def train(rows: DataFrame) -> PipelineModel | None:
    """A model of (text, label) rows; None without rows."""
    return None if rows.isEmpty() else pipeline().fit(rows)


def save(model: PipelineModel, folder: str, prefix: str = "model_") -> str:
    """Saves under a name with the minute, publishes it, and returns the path."""
    return registry.publish(SparkSession.getActiveSession(), folder, KIND, lambda path: model.write().save(path), prefix)


def predict(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """docs with logits (the raw scores), pred_class, pred_label and confidence; the model is loaded once, by the caller."""
    out = model.transform(docs).withColumn("logits", vector_to_array("rawPrediction")).withColumn("_p", vector_to_array("probability")).withColumn("pred_class", F.col("prediction").cast("int"))
    out = out.withColumn("confidence", F.array_max("_p") * 100).withColumn("pred_label", N.class_text(F.col("pred_class")))
    return out.select(*docs.columns, "logits", "pred_class", "pred_label", "confidence")


def load_latest(spark: SparkSession, base: str) -> PipelineModel:
    """The model saved last in a folder of models; an error if there is none."""
    return PipelineModel.load(_latest(spark, base)[0])


def predict_with_latest(docs: DataFrame, base: str) -> DataFrame:
    """Predictions by the model saved last, of either kind."""
    path, kind = _latest(docs.sparkSession, base)
    if kind == linear.KIND:
        return linear.predict(docs, linear.load(docs.sparkSession, path).weights)
    return predict(PipelineModel.load(path), docs)


def _latest(spark: SparkSession, base: str) -> tuple[str, str]:
    """By the manifest; in a folder without one, as older runs left it, by the folders' times."""
    return registry.newest(spark, base) or (latest_model(model_folders(spark, base)).first()["path"], KIND)
