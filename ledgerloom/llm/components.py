"""Connected components of a graph given as links: large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that can be reached.

    A large star hangs a node's greater neighbours under its least one, a small star does so with its lesser ones;
    repeated, each component ends as one star. The least neighbour comes from an aggregate, so no task gathers the
    neighbours of a node, however many it has.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = scratch.save(stars, "stars")
        scratch.drop(edges)
        edges = stars
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
