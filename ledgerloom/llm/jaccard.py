"""N-gram Jaccard join: fixed-size subsets for small sets, inverted lists for large ones, the boundary set by cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, beside_hot, bound_batches, finish, ngram_hashes, or_empty, rows_of, word_hashes
from .components import components

#: Words of a shingle; links need intersection / union of at least PERCENT / 100.
SHINGLE, PERCENT = 4, 85
#: Counters of the frequency sketch, dealt out in blocks for summing. Their number is fixed, so the sketch is 4 MB at any size.
COUNTERS, BLOCK = 1 << 20, 1 << 14
#: Shingles in a subset of a small set, and the size beyond which subsets are never tried.
SUBSET, LARGEST_SMALL = 2, 256
#: Sketches of so many tasks are summed by one group.
FAN_IN = 256


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text, hashed and sorted; with fewer words than n the whole sequence is one."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < n:
        return finish(ngram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(ngram_hashes(h, n))


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set of sorted shingles; equal sets have equal ids."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Shingles that a set of this size shares with any set it links to, at least."""
    return -(-percent * size // 100)


_BLOCKS = "block int, counts binary"


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a task's shingles fall on each counter."""
        counts, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for (texts,) in rows_of(batches, "text", rows=512):
            held += [(shingles(t, shingle) >> np.uint64(44)).astype(np.int32) for t in texts]
            size += sum(map(len, held[-len(texts) :]))
            if size > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if counts.any():
            raw = [counts[k : k + BLOCK].astype("<u4").tobytes() for k in range(0, COUNTERS, BLOCK)]
            yield pa.RecordBatch.from_pydict({"block": list(range(len(raw))), "counts": raw}, schema=arrow_schema(_BLOCKS))

    return run


def _summed(key, rows):
    total = np.zeros(BLOCK, np.int64)
    for raw in rows["counts"].to_pylist():
        total += np.frombuffer(raw, "<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
    return pa.table({"block": [key[0].as_py()], "counts": [total]}, schema=arrow_schema(_BLOCKS))


def frequencies(rows: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The sketch over all documents: sums go up a tree, FAN_IN tasks to a group."""
    parts = rows.select("text").mapInArrow(_sketch(shingle), _BLOCKS).withColumn("_branch", F.floor(F.spark_partition_id() / FAN_IN))
    once = parts.groupBy("block", "_branch").applyInArrow(_summed, _BLOCKS)
    out = np.zeros(COUNTERS, np.uint32)
    for r in once.groupBy("block").applyInArrow(_summed, _BLOCKS).collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<u4")
    return out


_SETS = "doc_id long, text_key long, size int, cid long, central double, lists long, prefix array<long>"


def _sets(sketch, percent: int, shingle: int):
    schema = arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's set: its size, its id, and its rarest shingles, in the order that all sets share."""
        counts = sketch.value
        usual = int(counts.mean())
        for ids, text_keys, texts in rows_of(batches, "doc_id", "text_key", "text", rows=512):
            out = []
            for doc, text_key, text in zip(ids, text_keys, texts):
                s = shingles(text, shingle)
                if not len(s):
                    out.append((doc, text_key, 0, 0, 0.0, 0, []))
                    continue
                often = counts[(s >> np.uint64(44)).astype(np.int64)]
                first = s[np.argsort(often, kind="stable")[: len(s) - least_overlap(len(s), percent) + SUBSET]]
                rare = counts[(first >> np.uint64(44)).astype(np.int64)].astype(np.int64) - usual
                out.append((doc, text_key, len(s), set_id(s), float(np.log1p(np.sort(often)[: len(first)].astype(float)).mean()), int(np.maximum(rare, 1).sum()), first.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


_TILED = "block long, i int, j int, side int, cid long, root long, s binary"
#: Bytes of whole sets that a task passes on in one go.
PASSED = 8 << 20


def _placed_sets(shingle: int):
    schema = arrow_schema(_TILED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets, made again from their texts, once for each tile that they go to."""
        out, size = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for cids, places, texts in rows_of(batches, "cid", "places", "text", rows=256):
            for cid, own, text in zip(cids, places, texts):
                s = shingles(text, shingle)
                if set_id(s) != cid:  # another row that shares the id
                    continue
                raw = s.tobytes()
                for p in own:
                    out.append((p["block"], p["i"], p["j"], p["side"], cid, p["root"], raw))
                    size += len(raw)
                    if size > PASSED:
                        yield told()
                        out, size = [], 0
        if out:
            yield told()

    return run


def boundary(sets: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets are small: where subsets written plus lists scanned cost least.

    A small set costs its subsets. A large one costs the lengths of the lists of its rarest shingles, as the sketch
    has them. Costs are summed by size, so what comes back has LARGEST_SMALL rows at most.
    """
    by = {r["size"]: (r["n"], r["lists"]) for r in sets.where(F.col("size").between(1, LARGEST_SMALL)).groupBy("size").agg(F.count("*").alias("n"), F.sum("lists").alias("lists")).collect()}
    cost = best = sum(x for _, x in by.values())
    at = 0
    for size in sorted(by):
        n, lists = by[size]
        m = size - least_overlap(size, percent) + SUBSET
        cost += n * (m * (m - 1) // 2) - lists
        if cost < best:
            best, at = cost, size
    return at


def _entries(heads: DataFrame, small: int, percent: int) -> DataFrame:
    """(key, cid, size, central, at): two sets that link meet under a key. at: shingles before the key's in the shared order."""
    pick = F.col("prefix")
    single = F.slice(pick, 1, F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1)
    # a small set is also listed where a large one may link to it
    listed = F.when(F.col("size") * 100 >= percent * (small + 1), F.transform(single, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
    pairs = F.flatten(F.transform(pick, lambda x, i: F.transform(F.slice(pick, i + 2, F.size(pick)), lambda y: F.struct(F.xxhash64(x, y).alias("key"), F.lit(0).alias("at")))))
    subsets = F.when((F.col("size") <= small) & (F.size(pick) >= 2), pairs)
    empty = F.array().cast("array<struct<key:bigint,at:int>>")
    every = F.explode(F.concat(F.coalesce(listed, empty), F.coalesce(subsets, empty)))
    rows = heads.select("cid", "size", F.col("central").cast("float").alias("central"), every.alias("e"))
    return rows.select(F.col("e.key").alias("key"), "cid", "size", "central", F.col("e.at").alias("at"))


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, counts: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sets of na and nb shingles can link, judged by their rarest shingles alone; never false for sets that link.

    Before the last of the other's shingles listed, whatever stands in one list and not in the other is in one set only.
    """

    def ranks(s: np.ndarray) -> np.ndarray:
        return (counts[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))

    ra, rb = ranks(a), ranks(b)
    end_a = np.uint64(2**64 - 1) if len(a) == na else ra.max(initial=0)
    end_b = np.uint64(2**64 - 1) if len(b) == nb else rb.max(initial=0)
    lone_a, lone_b = int((~np.isin(a, b) & (ra < end_b)).sum()), int((~np.isin(b, a) & (rb < end_a)).sum())
    return min(na - lone_a, nb - lone_b) * (100 + percent) >= percent * (na + nb)


_PAIRS = "a long, b long"


def _screen(sketch, percent: int):
    schema = arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        own = lambda x: np.array(x, np.int64).view(np.uint64)
        for a, b, na, nb, pa_, pb in rows_of(batches, "a", "b", "na", "nb", "pa", "pb"):
            kept = [may_link(own(x), own(y), n, m, counts, percent) for x, y, n, m in zip(pa_, pb, na, nb)]
            yield pa.RecordBatch.from_pydict({"a": [x for x, k in zip(a, kept) if k], "b": [x for x, k in zip(b, kept) if k]}, schema=schema)

    return run


def _screened(pairs: DataFrame, heads: DataFrame, sketch, percent: int, scratch: Scratch) -> DataFrame:
    """The saved pairs that their sizes and rarest shingles don't rule out."""
    heads = scratch.save(_mostly_in(heads.select("cid", "size", "prefix"), "cid", _either(pairs)), "few_heads")
    side = lambda c: heads.select(F.col("cid").alias(c), F.col("size").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    both = beside_hot(beside_hot(pairs, side("b"), "b", scratch), side("a"), "a", scratch).where(_alike(F.col("na"), F.col("nb"), percent))
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_screen(sketch, percent), _PAIRS)


#: Bits of the filter that keeps most rows out of a join; with many ids it lets more through, and its size stays.
FILTER_BITS = 1 << 23


def _mostly_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ids (column key), and a few more: a bitmap of hashed ids, of FILTER_BITS / 64 rows at most."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({key}), 64) AS INT))")
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return found.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()


def _alike(a, b, percent: int):
    """Whether sets of these sizes can link."""
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def _open(size: str, at: str, other_size: str, other_at: str, percent: int):
    """Whether sets can link whose first common shingle stands at these places at the earliest: enough come after it."""
    m, i, n, j = (F.col(c) for c in (size, at, other_size, other_at))
    return _alike(m, n, percent) & (F.least(m - i, n - j) * (100 + percent) >= percent * (m + n))


#: Sets of a block that meet pair by pair; sets of larger blocks meet in tiles, so pairs grow with the sets and not with their square.
FEW = 32
#: Sets, and shingles, of each side of a tile.
TILE, TILE_SHINGLES = 2000, 1 << 20
#: What a set is in a tile.
_PROBE, _LISTED = 1, 2


def _tiles(percent: int):
    schema = arrow_schema(_PAIRS)

    def meet(probes: list, listed: list) -> Iterator[tuple[int, int]]:
        """For each probe one link into each other component that a listed set of its tile links it to."""
        sets = [np.frombuffer(s, np.uint64) for _, _, s in listed]
        cids, roots, sizes = np.array([c for c, _, _ in listed]), np.array([r for _, r, _ in listed]), np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for cid, root, raw in probes:
            own = np.frombuffer(raw, np.uint64)
            first, last = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            n = last - first
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            shared = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((shared * 100 >= percent * (len(own) + sizes - shared)) & (roots != root))
            for y in hit[np.unique(roots[hit], return_index=True)[1]].tolist():
                yield min(cid, int(cids[y])), max(cid, int(cids[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come one after another: rows are sorted by (block, i, j)."""
        now, sides = None, ({}, {})

        def told() -> Iterator[pa.RecordBatch]:
            pairs = sorted(set(meet(*(list(x.values()) for x in sides)))) if all(sides) else []
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, schema=schema)

        for rows in rows_of(batches, "block", "i", "j", "side", "cid", "root", "s", rows=256):
            for block, i, j, side, cid, root, s in zip(*rows):
                if (block, i, j) != now:
                    yield from told()
                    now, sides = (block, i, j), ({}, {})
                for k, own in enumerate((_PROBE, _LISTED)):
                    if side & own:
                        sides[k][cid] = (cid, root, s)
        yield from told()

    return run


#: Bytes of a table that goes to all tasks, at most; beyond that it is joined by a shuffle.
SENT = 32 << 20


def _met_in_tiles(sets: DataFrame, heads: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between sets (block, cid, root, size, probe, listed) of the same block and of other roots, by their whole sets.

    Sets that are probes scan the lists of the shingles of sets that are listed. Either side of a block is dealt into
    parts of TILE sets and TILE_SHINGLES shingles or so, and each part of one meets each of the other in a tile. So no
    block is too large for a task, and no pair is written but links.
    """
    mass = lambda of, out: F.greatest(F.ceil(F.count_if(of) / TILE), F.ceil(F.sum(F.when(F.col(of), F.col("size"))) / TILE_SHINGLES)).cast("int").alias(out)
    parts = scratch.save(sets.groupBy("block").agg(mass("probe", "_i"), mass("listed", "_j"), F.count("*").alias("n")).where("_i > 0 AND _j > 0"), "parts")
    part, every = (lambda n: F.array(F.pmod(F.xxhash64("cid"), F.col(n)).cast("int"))), (lambda n: F.sequence(F.lit(0), F.col(n) - 1))
    places = lambda i, j, side: F.flatten(F.transform(i, lambda x: F.transform(j, lambda y: F.struct(x.alias("i"), y.alias("j"), F.lit(side).alias("side")))))
    both = F.col("probe") & F.col("listed") & (F.col("_i") == 1) & (F.col("_j") == 1)
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    apart = F.concat(F.when(F.col("probe"), places(part("_i"), every("_j"), _PROBE)).otherwise(none), F.when(F.col("listed"), places(every("_i"), part("_j"), _LISTED)).otherwise(none))
    rows = beside_hot(sets, parts.drop("n"), "block", scratch, parts).withColumn("at", F.explode(F.when(both, places(part("_i"), part("_j"), _PROBE | _LISTED)).otherwise(apart)))
    place = F.struct("block", "at.i", "at.j", "at.side", "root")
    owners = heads.select("cid", F.col("rep").alias("doc_id")).join(rows.groupBy("cid").agg(F.collect_list(place).alias("places")), "cid")
    owners = scratch.save(owners, "owners")
    size = owners.agg(F.sum(64 + 32 * F.size("places"))).first()[0] or 0
    source = _mostly_in(texts.select("doc_id", "text"), "doc_id", owners).join(F.broadcast(owners) if size <= SENT else owners, "doc_id")
    rows = source.select("cid", "places", "text").mapInArrow(_placed_sets(shingle), _TILED)
    return rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_tiles(percent), _PAIRS)


def _as_blocks(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Sets for _met_in_tiles() out of pairs (a, b): a block for each b, which is listed."""
    own = lambda c, probe: pairs.select(F.col("b").alias("block"), F.col(c).alias("cid"), F.lit(probe).alias("probe"), F.lit(not probe).alias("listed")).distinct()
    return own("a", True).unionByName(own("b", False)).join(heads.select("cid", "size"), "cid").withColumn("root", F.col("cid"))


def _rest(placed: DataFrame, heads: DataFrame, texts: DataFrame, sketch, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links of the sets that lie outside their leader's component, to sets under their keys that lie in another one."""
    many = placed.where("NOT few").select("block", "cid", "root", "size", (F.col("root") != F.col("main_root")).alias("probe"), F.lit(True).alias("listed"))
    packed = _met_in_tiles(many, heads, texts, shingle, percent, scratch)
    packed = scratch.save(packed.distinct(), "packed")
    few = placed.where("few")
    apart = few.where("root <> main_root").select("block", *[F.col(c).alias(f"x_{c}") for c in ("cid", "size", "at", "root")])
    cross = apart.join(few, "block").where("x_root <> root")
    cross = cross.where(_open("x_size", "x_at", "size", "at", percent))
    cross = scratch.save(cross.select(F.least("x_cid", "cid").alias("a"), F.greatest("x_cid", "cid").alias("b")).distinct(), "cross")
    cross = scratch.save(_screened(cross, heads, sketch, percent, scratch), "left")
    more = _met_in_tiles(_as_blocks(cross, heads), heads, texts, shingle, percent, scratch)
    return packed.unionByName(scratch.save(more.distinct(), "more"))


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for every document; text_key is a hash of its text.

    Equal sets are one node. A sketch of all shingles' frequencies gives the order in which every set lists its rarest
    shingles first. Sets that link share two of the first few in that order, so small sets write all subsets of two of
    them; large sets, for which that is too many, are listed under the single ones. boundary() sets the dividing size.

    Sets under one key are first held against the most central of them, its leader, one link a set and key; components
    of the links found so join most near copies. Then every set outside its leader's component is held against all sets
    under its keys that are in another component. So no link between components is missed, and pairs within one, which
    change nothing, are not made. Keys with one leader, which near copies share by the hundred, make one block where
    the sets are few or that costs less than the keys one by one. Blocks of a few sets write pairs, of which sizes, places in the order and
    rarest shingles rule out most; in larger blocks sets meet in tiles, and only links are written. Whole sets are made
    again from the texts, for those sets alone that meet others.

    A null or empty text has no shingles, links with nothing and is its own component. A row without an id links with
    nothing and has a null component. Repeated rows are linked; ids shared by different texts are one row each. An
    empty table gives no rows; other columns are ignored. A very long text is one set, made and held whole by one task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch = spark.sparkContext.broadcast(frequencies(texts, shingle))
    made = scratch.save(texts.mapInArrow(_sets(sketch, percent, shingle), _SETS), "sets")
    heads = made.where("doc_id IS NOT NULL AND size > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("size", "central", "lists", "prefix")])
    heads = scratch.save(heads, "heads")
    entries = _entries(heads, boundary(heads, percent), percent)

    # most keys are one set's alone: those go first, by a count; what stays has its number of rows beside it, for the joins
    keys = scratch.save(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    met = scratch.save(beside_hot(entries, keys, "key", scratch, keys), "met")
    leaders = met.groupBy("key").agg(F.max_by(F.struct("cid", "size", "at"), "central").alias("m"), F.any_value("n").alias("n"))
    leaders = scratch.save(leaders.select("key", F.col("m.cid").alias("main"), F.col("m.size").alias("main_size"), F.col("m.at").alias("main_at"), "n"), "leaders")
    led = scratch.save(beside_hot(met.drop("central", "n"), leaders, "key", scratch, leaders), "led")
    scratch.drop(met)
    members = scratch.save(led.groupBy("main", "cid").agg(F.any_value("size").alias("size"), F.min("at").alias("at")), "members")
    costs = members.groupBy("main").agg(F.count("*").alias("main_n")).join(leaders.groupBy("main").agg(F.sum(F.col("n") * F.col("n")).alias("keys_cost")), "main")
    costs = scratch.save(costs.withColumn("as_one", (F.col("main_n") <= FEW) | (F.col("main_n") * F.col("main_n") <= F.col("keys_cost"))), "costs")

    stars = led.where(F.col("cid") != F.col("main")).where(_open("size", "at", "main_size", "main_at", percent)).select(F.col("cid").alias("a"), F.col("main").alias("b")).distinct()
    stars = scratch.save(_screened(scratch.save(stars, "stars"), heads, sketch, percent, scratch), "near")
    links = scratch.save(_met_in_tiles(_as_blocks(stars, heads), heads, texts, shingle, percent, scratch).distinct(), "links")

    roots = components(links, scratch)
    own = lambda df, c, root: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{root}")), c, "left").withColumn(root, F.coalesce(f"_{root}", c)).drop(f"_{root}")
    # a block is a leader's keys or one key; at is the least place of the set's keys in it
    one = costs.where("as_one")
    whole_blocks = beside_hot(members, one.drop("as_one", "keys_cost"), "main", scratch, one.withColumnRenamed("main_n", "n")).select(F.xxhash64(F.lit(1), "main").alias("block"), (F.col("main_n") <= FEW).alias("few"), "main", "cid", "size", "at")
    apart = scratch.save(costs.where("NOT as_one").select("main"), "apart")
    key_blocks = _mostly_in(led, "main", apart).join(apart, "main").select(F.xxhash64(F.lit(2), "key").alias("block"), (F.col("n") <= FEW).alias("few"), "main", "cid", "size", "at")
    blocks = scratch.save(own(own(whole_blocks.unionByName(key_blocks), "cid", "root"), "main", "main_root"), "blocks")
    open_ = scratch.save(blocks.groupBy("block").agg(F.count_if(F.col("root") != F.col("main_root")).alias("out"), F.count("*").alias("n")).where("out > 0").select("block", "n"), "open")
    if not open_.isEmpty():  # else no set lies outside its leader's component
        placed = beside_hot(blocks, open_.select("block"), "block", scratch, open_).select("block", "few", "cid", "root", "main_root", "size", "at")
        roots = components(links.unionByName(_rest(scratch.save(placed, "placed"), heads, texts, sketch, shingle, percent, scratch)), scratch)

    # a component's least document: equal sets first, then sets that link
    groups = heads.select("cid", "rep").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = groups.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = groups.join(least, "root").select(F.col("cid").alias("_cid"), "component_id")
    out = made.join(groups, (F.col("cid") == F.col("_cid")) & (F.col("size") > 0) & F.col("doc_id").isNotNull(), "left")
    scratch.keep_only(made, heads, roots)
    return out.select("doc_id", "text_key", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The document of least id of every component, with all columns, whatever their names.

    Repeated rows leave one, rows without an id stay. Of rows that share the least id and have different texts one a
    text stays. A null or empty text is in no group and stays; an empty table gives none.
    """
    kept = linked(docs, percent, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("id"), "text_key").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(or_empty("text")).alias("text_key"), F.struct(*docs.columns).alias("row"))
    rows = rows.where("id IS NOT NULL").join(kept, ["id", "text_key"]).groupBy("id", "text_key").agg(F.first("row").alias("row"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
