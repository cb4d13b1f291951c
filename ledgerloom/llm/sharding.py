"""Sharding by a hierarchical weighted hash tree: region, rack and shard, each level by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, content_order, or_empty, running_sums, with_bins

#: The standing layout: regions of two racks of four shards.
RACKS, LEAVES = 2, 4


@dataclass(frozen=True)
class Node:
    """A leaf holds a shard; an inner node weighs as much as its children."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def layout(shards: int, base: int | None = None, weights: dict[int, float] | None = None) -> Node:
    """The tree of so many shards, grown from a base of fewer.

    The base's shards fill regions of RACKS racks of LEAVES shards. Each shard beyond the base opens a region of its
    own, so weights change only at the root: its new child alone gains, and rows move into that subtree and nowhere else.
    """
    base, weights = min(base or shards, shards), weights or {}
    leaf = lambda s: Node(f"shard{s}", s, weights.get(s, 1.0))
    regions = []
    for r in range(0, base, RACKS * LEAVES):
        racks = [tuple(leaf(s) for s in range(k, min(k + LEAVES, base, r + RACKS * LEAVES))) for k in range(r, min(r + RACKS * LEAVES, base), LEAVES)]
        regions.append(Node(f"region{r}", children=tuple(Node(f"rack{r}.{k}", children=x) for k, x in enumerate(racks))))
    regions += [Node(f"grown{s}", children=(Node(f"rack{s}", children=(leaf(s),)),)) for s in range(base, shards)]
    return Node("root", children=tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """An exponential draw at the node's weight: the least of several wins in proportion to weights."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(u) / F.lit(float(node.weight))


def _step(key: Column, node: Node) -> Column:
    """The place of the child that wins."""
    if len(node.children) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]


def descend(df: DataFrame, tree: Node, key: str, out: str) -> DataFrame:
    """Adds the shard that the key's draws lead to, one projection a level."""
    df, level = df.withColumn("_at", F.lit(0)), [tree]
    while any(n.children for n in level):
        step = F.lit(0)
        below: list[Node] = []
        for i, n in enumerate(level):
            kids = n.children or (n,)
            chosen = F.lit(len(below)) + (_step(F.col(key), n) if n.children else F.lit(0))
            step = F.when(F.col("_at") == i, chosen).otherwise(step)
            below += kids
        df, level = df.withColumn("_at", step), below
    return df.withColumn(out, F.element_at(F.array(*[F.lit(n.shard) for n in level]), F.col("_at") + 1)).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 16, weights: dict[int, float] | None = None) -> DataFrame:
    """Each document's shard, its slot there, and its shard once there is one more.

    The law is `key`: the id and the number of shards decide. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32,
    law, shard, slot (gapless from 0 in each shard), grown_shard. A null text is empty; rows without an id share the
    null key and so a shard; repeated rows share a shard and have slots of their own. Of a very long text only its
    size and checksum go on. Empty tables give no rows; other columns are ignored.
    """
    text = or_empty("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = descend(rows, layout(shards, shards, weights), "doc_id", "shard")
    rows = descend(rows, layout(shards + 1, shards, weights), "doc_id", "grown_shard")
    rows = Scratch(docs.sparkSession, "sharding").save(rows, "drawn")  # texts are read once; slots come from this narrow table
    rows = with_bins(rows.withColumn("_one", F.lit(1)).withColumn("_order", content_order(F.col("doc_id"), F.col("text_crc32"))), "_order")
    rows = running_sums(rows, ["shard"], ["_order", "doc_id", "text_crc32"], {"slot": "_one"})
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
