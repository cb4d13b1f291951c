"""Linear models: training against a plain loop, scores, the registry of models, counts in one pass."""

import hashlib
import math
import re
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import linear as LN
from ledgerloom.operators import model as M
from ledgerloom.plans import training
from ledgerloom.sources import fixtures as S
from ledgerloom.sources import registry
from ledgerloom.sources.shared import Tables, shared_dir


def place(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:4], 16)


def words(text):
    return [place(t) for t in re.split(r"\s+", text or "") if t][:128]


def plain(rows, epochs=LN.EPOCHS, batches=LN.BATCHES, rate=LN.RATE):
    """Weights and losses of (key, text, label) rows, row by row."""
    unit = lambda x: math.floor(x + 0.5)
    made = [(place("" if k is None else str(k)) % batches, words(t), float(y)) for k, t, y in rows if y is not None]
    w, squares, losses = {-1: 0.0}, {}, []
    for _ in range(epochs):
        loss = 0
        for batch in range(batches):
            own, sums = [r for r in made if r[0] == batch], {}
            for _, b, y in own:
                x = 1 / math.sqrt(max(len(b), 1))
                p = 1 / (1 + math.exp(-((unit(w[-1] * LN.LOGIT) + sum(unit(w.get(k, 0.0) * x * LN.LOGIT) for k in b)) / LN.LOGIT)))
                for k in b:
                    sums[k] = sums.get(k, 0) + unit((p - y) * x * LN.GRADIENT)
                sums[-1] = sums.get(-1, 0) + unit((p - y) * LN.GRADIENT)
                loss += unit(-math.log(max(p if y else 1 - p, 1e-12)) * LN.GRADIENT)
            for k, g in sums.items():
                mean = g / LN.GRADIENT / len(own)
                squares[k] = squares.get(k, 0.0) + mean * mean
                w[k] = w.get(k, 0.0) - rate * mean / (math.sqrt(squares[k]) + LN.LEAST)
        losses.append(loss / LN.GRADIENT / len(made))
    return w, losses


def test_training_is_the_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = docs.select("doc_id", "text", F.col("toxic").alias("label"))
    made = LN.train(rows, key="doc_id")
    weights, loss = plain([tuple(r) for r in rows.collect()])
    got = {r["bucket"]: r["weight"] for r in made.weights.collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-5 for k in got)
    assert made.loss == pytest.approx(loss, abs=1e-5) and all(a > b for a, b in zip(made.loss, made.loss[1:])) and len(loss) == 5
    again = LN.train(rows.repartition(3, "text").sortWithinPartitions(F.desc("doc_id")), key="doc_id")
    assert again.loss == made.loss and {r["bucket"]: r["weight"] for r in again.weights.collect()} == got


def test_rows_without_labels_texts_or_keys(spark):
    rows = [(1, "good day", 0), (2, "bad day", 1), (None, None, 0), (4, "", 1), (4, "", 1), (5, "no label", None), (6, "long " * 50_000, 1)]
    made = LN.train(spark.createDataFrame(rows, "id long, text string, label int"))
    weights, _ = plain(rows)
    got = {r["bucket"]: r["weight"] for r in made.weights.collect()}
    assert got == pytest.approx(weights, abs=1e-6)
    assert LN.train(spark.createDataFrame([(1, "x", None)], "id long, text string, label int")) is None
    docs = spark.createDataFrame([("good day", 1), (None, 2), ("never seen", 3)], "text string, _z int")
    out = {r["_z"]: r for r in LN.predict(docs, made.weights).collect()}
    assert out[2]["logits"] == pytest.approx([-got[-1] / 2, got[-1] / 2], abs=1e-6)
    z = got[-1] + sum(got.get(k, 0) for k in words("good day")) / math.sqrt(2)
    assert out[1]["logits"][1] == pytest.approx(z / 2, abs=1e-6) and out[1]["pred_class"] == int(z > 0)
    assert out[1]["confidence"] == pytest.approx(100 / (1 + math.exp(-abs(z))), abs=1e-4)


def test_scoring_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = LN.predict(docs, LN.as_table(spark, {-1: 0.5, 3: 1.0}))._jdf.queryExecution().executedPlan().toString()
    outer = [line for line in plan.split("\n") if not re.match(r"^[ :]*:", line)]
    assert "Python" not in plan and not any("Exchange" in line for line in outer)


def test_two_saves_of_a_minute_both_stay(spark, tmp_path):
    base = str(tmp_path / "models")
    a, b = (LN.Linear(LN.as_table(spark, {-1: w}), [1.0, 0.5]) for w in (1.0, -1.0))
    first, second = LN.save(a, base), LN.save(b, base)
    assert first != second and first[:-9] <= second[:-9]
    assert registry.published(spark, base).count() == 2 and registry.newest(spark, base) == (second, LN.KIND)
    assert LN.load(spark, first).weights.first()["weight"] == 1.0 and LN.load(spark, second).loss == [1.0, 0.5]
    docs = spark.createDataFrame([("x",)], "text string")
    assert M.predict_with_latest(docs, base).first()["pred_class"] == 0


def test_a_model_half_written_is_not_read(spark, tmp_path):
    base = str(tmp_path / "models")
    good = registry.publish(spark, base, "k", lambda path: None)

    def fails(path):
        (tmp_path / "models" / path.rsplit("/", 1)[1]).mkdir(parents=True)
        raise OSError("disk")

    with pytest.raises(OSError):
        registry.publish(spark, base, "k", fails)
    assert registry.newest(spark, base) == (good, "k")


def test_readers_beside_writers(spark, tmp_path):
    """Each reader sees whole entries only, and never an older model than before."""
    base, seen, done = str(tmp_path / "models"), [], threading.Event()
    registry.publish(spark, base, "k", lambda path: None)

    def read():
        while not done.is_set():
            seen.append(registry.newest(spark, base)[0])

    reader = threading.Thread(target=read)
    reader.start()
    made = [registry.publish(spark, base, "k", lambda path: None) for _ in range(6)]
    done.set()
    reader.join()
    order = {p: k for k, p in enumerate(made, 1)}
    ranks = [order.get(p, 0) for p in seen]
    assert ranks == sorted(ranks) and registry.newest(spark, base)[0] == made[-1] and registry.published(spark, base).count() == 7


def test_statuses_are_counted_by_the_training_pass(spark, sf_dir, tmp_path):
    texts = S.report_texts(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "(000001) 2024.02.31"), (-2, None)], "report_id long, raw_text string"))
    texts = texts.withColumn("error", F.when(F.col("report_id") % 50 == 1, "unreadable"))
    prices = S.prices(spark, sf_dir).withColumn("trade_date", F.add_months("trade_date", 300))
    path, counts = training.run_linear(texts, prices, str(tmp_path / "m"))
    assert path.startswith(str(tmp_path)) and sum(counts.values()) == texts.count()
    assert counts == {r["status"]: r["n"] for r in training.batch_report(texts, prices).collect()} and counts["error"] > 0 and counts["ok"] > 0
    made, _ = training.observed_set(texts.where("error IS NULL").drop("error"), prices)
    want = training.training_set(texts.where("error IS NULL"), prices)
    assert made.count() == want.count() == counts["ok"] and made.exceptAll(want).isEmpty()


def test_tables_go_when_the_block_ends(spark):
    fs = spark._jvm.org.apache.hadoop.fs
    with Tables(spark, "test") as kept:
        assert kept.save(spark.range(5), "r").count() == 5
        root = fs.Path(kept.root)
        assert root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root) and kept.root.startswith(shared_dir(spark))
    assert not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
