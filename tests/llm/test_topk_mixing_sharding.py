"""Top-k search, source mixing and sharding on small fixtures, by brute force and by their laws."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, sharding, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def best(vectors, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        own = sorted(((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i and len(c) == len(q)))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(own, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()))


def test_top_k_with_ties_and_odd_vectors(spark):
    import numpy as np

    r = random.Random(1)
    rows = [(i, [float(np.float32(r.uniform(-1, 1))) for _ in range(6)], 0) for i in range(300)]
    rows += [(i, [0.5] * 6, None) for i in range(300, 330)] + [(0, [0.25] * 6, 1), (7, [0.5] * 6, 1), (7, [0.5] * 6, 1)]
    rows += [(400, None, 0), (450, [None] * 6, 0), (401, [float("nan")] * 6, 0), (402, [float("inf")] * 6, 0), (None, [0.1] * 6, 0), (500, [0.1] * 3, 0), (501, [0.2] * 3, 0), (550, [], 0)]
    assert found(spark.createDataFrame(rows, VECTORS)) == best([(i, v) for i, v, _ in rows], 5)


def test_top_k_levels_of_the_tree(spark):
    rows = [(i, [((i * 37) % 101) / 50 - 1, ((i * 53) % 97) / 50 - 1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, query_block=5, shard_rows=10)
    assert sorted(map(tuple, got.collect())) == best(rows, 5)


def test_top_k_empty_and_large_values(spark):
    none = spark.createDataFrame([], VECTORS)
    assert found(none) == []
    big = [(0, [3e6, 1.0], 0), (1, [2e6, -2.0], 0), (2, [-1e6, 5.0], 0)]
    assert found(spark.createDataFrame(big, VECTORS)) == best([(i, v) for i, v, _ in big], 5)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    r = random.Random(2)
    if rows is None:
        rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), "en", r.choice(["a", "b", "c", "d", "d", "d", "\U0001f600", None]), 0) for i in range(400)]
        rows += [(3, "same row", "en", "a", 8)] * 3 + [(None, "no id", None, None, None), (900, None, None, "a", None), (901, "", "en", "zz", 0), (902, " \n ", "en", "é", 3)]
    return spark.createDataFrame(rows, DOCS)


def shares(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w, most = {s: weights[k % 3] for k, s in enumerate(names)}, {s: 2.0 * n for s, n in sizes.items()}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_targets(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0) and (r["again"] is None) == (r["taken"] <= r["size"])
    want = shares(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_of_very_long_texts_and_other_columns(spark):
    """A text of 300,000 words is counted and taken whole; columns of any names, nulls and repeated rows change nothing."""
    rows = [(1, "word " * 300_000, "a"), (2, "two words", "a"), (3, None, "b"), (4, "x", None), (4, "x", None), (5, "y z", "b")]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, source string, size string, target double")
    got = sorted(map(str, mixing.mixed(docs).collect()))
    assert got == sorted(map(str, mixing.mixed(docs.select("doc_id", "text", "source")).collect()))
    by = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert by[1]["size"] == 300_000 and by[1]["source_size"] == 300_002 and by[3]["taken"] == 0 and 0 < by[1]["taken"] <= 600_000


def test_mix_follows_schedules(spark):
    rows = mixing.mixed(documents(spark)).where("position IS NOT NULL").collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    for start, end in mixing.SCHEDULES:
        for share in (0.0, 0.2, 0.7, 1.0):
            t = spark.range(1).select(mixing.when_demanded(F.lit(share), F.lit(start), F.lit(end))).first()[0]
            assert start * t + (end - start) * t * t / 2 == pytest.approx(share)


def test_readings_have_the_words_taken(spark):
    docs = documents(spark).withColumn("size", F.lit("a clash")).withColumn("taken", F.lit(1))
    plan, rows = mixing.mix(docs).collect(), mixing.readings(docs).collect()
    assert rows[0].asDict().keys() == set(docs.columns)
    words, want = defaultdict(int), defaultdict(int)
    for r in rows:
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in words.items() if v}
    texts = {r["text"] for r in docs.collect()}
    assert all(r["text"] in texts or any((t or "").startswith(r["text"]) for t in texts) for r in rows)
    assert mixing.readings(docs.limit(0)).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [(1, "", "en", "a", 0), (2, None, None, None, None)])).where("taken > 0").count() == 0


def test_shards(spark):
    docs = documents(spark).withColumn("shard", F.lit("a clash"))
    rows = sharding.shard_documents(docs).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    whole = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for (i, t), n in texts.items() for _ in range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == whole
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_tree_draws(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = sharding.layout(16, weights={5: 3.0})
    n = {r["s"]: r["count"] for r in sharding.descend(ids, tree, "doc_id", "s").groupBy("s").count().collect()}
    assert n[5] == pytest.approx(20000 * 3 / 18, rel=0.1) and all(v == pytest.approx(20000 / 18, rel=0.2) for s, v in n.items() if s != 5)
    steps = ids
    for shards in (16, 17, 18, 19):
        steps = sharding.descend(steps, sharding.layout(shards, 16), "doc_id", f"s{shards}")
    for a in (16, 17, 18):
        assert steps.where(f"s{a} <> s{a + 1} AND s{a + 1} <> {a}").isEmpty()
    moved = steps.where("s16 <> s17").count()
    assert moved == pytest.approx(20000 / 17, rel=0.15)
    # a heavier leaf takes rows from others; all that move come to rest in its region, the subtree whose weight changed
    heavier = sharding.descend(sharding.descend(ids, sharding.layout(16), "doc_id", "a"), sharding.layout(16, weights={2: 2.0}), "doc_id", "b")
    assert heavier.where("a <> b AND b >= 8").isEmpty() and not heavier.where("a >= 8 AND b < 8").isEmpty()


def plain_descent(doc_id, tree):
    """The shard of an id, by a walk down the tree with the same draws."""
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    node = tree
    while node.children:
        draw = lambda c: -math.log(((xxhash.xxh64_intdigest(c.name.encode(), seed) >> 11) + 0.5) / 2**53) / c.weight
        node = min(node.children, key=draw)
    return node.shard


def test_shards_against_plain_descent(spark):
    ids = [*range(-50, 3000), None, 2**62, -(2**63)]
    docs = spark.createDataFrame([(i, "x" * 30_000 if i == 7 else f"text {i}") for i in ids], "doc_id long, text string").withColumns({"shard": F.lit("a clash"), "slot": F.lit(1)})
    for weights in (None, {0: 3.0, 5: 0.25}):
        rows = sharding.shard_documents(docs, 16, weights).collect()
        now, grown = sharding.layout(16, 16, weights), sharding.layout(17, 16, weights)
        assert [(r["shard"], r["grown_shard"]) for r in rows] == [(plain_descent(r["doc_id"], now), plain_descent(r["doc_id"], grown)) for r in rows]
        assert len(rows) == len(ids) and {r["size"] for r in rows if r["doc_id"] == 7} == {30_001}


def test_release_leaves_nothing_behind(spark):
    """Tables of operators stay for their results, and go when the caller is done with these."""
    from ledgerloom.llm import common, sharding

    docs = spark.createDataFrame([(k, f"text {k}", "a") for k in range(20)], "doc_id long, text string, source string")
    results = [mixing.mixed(docs), sharding.shard_documents(docs, 4)]
    assert all(r.count() == 20 for r in results)
    roots = list(common.Scratch.roots)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda r: path(r).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(r))
    assert len(roots) >= 2 and there(roots[-1])
    assert common.release(spark) == len(roots) and not any(map(there, roots)) and common.release(spark) == 0
    assert mixing.mixed(docs).count() == 20
