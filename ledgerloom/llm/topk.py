"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of per-query lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

#: Rows of a block of queries and of a shard of candidates: a tile's inputs take about 4 MB each at 64 dimensions.
QUERY_BLOCK, SHARD = 8192, 8192
#: A product is computed on so many queries at once.
STEP = 512
#: Lists merged by one group at each level of the tree.
FAN_IN = 32
_TILE = "query_id long, query_key long, shard long, ids array<long>, scores array<long>"


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    values = col.combine_chunks()
    values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy(zero_copy_only=False)
    return np.floor(256.0 * values.astype(np.float64)).reshape(n, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them below 2**53, else Python's integers do and scores beyond 64 bits stop at their ends."""
    high = (np.abs(q).max(initial=0) or 1) * (np.abs(c).max(initial=0) or 1) * max(1, q.shape[1])
    if high < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    out = whole(q) @ whole(c).T
    return np.clip(out, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _select(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row whose ids ascend: ties go to smaller ids."""
    if len(row) > k:
        bar = np.partition(row, len(row) - k)[len(row) - k]
        above, level = np.flatnonzero(row > bar), np.flatnonzero(row == bar)
        at = np.concatenate([above, level[: k - len(above)]])
    else:
        at = np.arange(len(row))
    return at[np.lexsort((ids[at], -row[at]))]


def _tiles(k: int):
    schema = arrow_schema(_TILE)

    def tile(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if queries.num_rows and shard.num_rows:
            shard = shard.sort_by("_id")
            ids, c = shard["_id"].to_numpy(), _matrix(shard["_v"], shard.num_rows)
            qid, qkey, q = queries["_id"].to_pylist(), queries["_key"].to_pylist(), _matrix(queries["_v"], queries.num_rows)
            for at in range(0, len(qid), STEP):
                scores = _products(q[at : at + STEP], c)
                for i, row in enumerate(scores, at):
                    a, b = np.searchsorted(ids, qid[i]), np.searchsorted(ids, qid[i], side="right")
                    rest, of = (row, ids) if a == b else (np.delete(row, slice(a, b)), np.delete(ids, slice(a, b)))
                    best = _select(rest, of, k)
                    for col, x in zip(out, (qid[i], qkey[i], key[2].as_py(), of[best].tolist(), rest[best].tolist())):
                        col.append(x)
        return pa.table([pa.array(col, t) for col, t in zip(out, schema.types)], schema=schema)

    return tile


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, shard_rows: int = SHARD) -> DataFrame:
    """For each query its k candidates of highest inner product of floor(256 * x) components.

    Returns query_id, rank (from 1), vec_id, score. Queries and candidates are dealt into blocks and shards by hash;
    each tile multiplies a block by a shard and keeps k a query; lists are merged FAN_IN at a time, level by level.
    Vectors that are null, or hold a null or non-finite component, and rows without an id take no part; vectors meet
    only those of their own length. A candidate with the query's id is the query's own row. Repeated candidates count
    each; repeated query rows are answered once. Ties go to the smaller id. Fewer than k candidates give all there are;
    empty tables give no rows. Other columns are ignored.
    """

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), v.cast("array<double>").alias("_v"), F.size(v).alias("_dim"))

    vectors, queries = ready(vectors), ready(queries).dropDuplicates(["_id", "_v"]).withColumn("_key", F.xxhash64("_v"))
    blocks, shards = max(1, math.ceil(queries.count() / query_block)), max(1, math.ceil(vectors.count() / shard_rows))
    deal = lambda n, *c: F.pmod(F.xxhash64(F.lit("deal"), *c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_block", deal(blocks, "_id", "_key")).withColumn("_shard", every(shards))
    right = vectors.withColumn("_shard", deal(shards, "_id", F.xxhash64("_v"))).withColumn("_block", every(blocks))
    keys = ["_dim", "_block", "_shard"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tiles(k), _TILE)
    pairs = F.flatten(F.collect_list(F.arrays_zip("scores", "ids")))
    best = F.slice(F.array_sort(F.transform(pairs, lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("i")))), 1, k)
    while True:  # each level leaves a FAN_IN-th of the lists
        shards = math.ceil(shards / FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("query_id", "query_key", "shard").agg(best.alias("b"))
        if shards == 1:
            break
        lists = lists.select("query_id", "query_key", "shard", F.col("b.i").alias("ids"), F.transform("b.s", lambda s: -s).alias("scores"))
    out = lists.select("query_id", F.posexplode("b").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))
