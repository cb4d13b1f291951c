"""Near-duplicates by SimHash: fingerprints of whole texts, compared as bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, beside_hot, bound_batches, or_empty, rows_of
from .components import components

#: Words of a shingle, bits in which linked fingerprints differ at most, seed of the shingles' XXH64.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of each side of a tile, and fingerprints that a task compares in one go.
TILE, TOGETHER = 2048, 1 << 15
#: Rows (a probe against a block of 64 fingerprints) whose counters are updated together.
ROWS = 1 << 15
#: Planes after which rows that are wholly beyond the radius are left out, and then after every so many.
FIRST_LOOK, NEXT_LOOK = 8, 4
_CHUNK = 1 << 16
_ALL = np.uint64(2**64 - 1)


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included, of the words of a whole text; of the whole sequence where it has fewer words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[: -n] + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none. Signed, as Spark has it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


_PRINTS = "doc_id long, print long"


def _prints(shingle: int):
    schema = arrow_schema(_PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text", rows=512):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], pa.int64())], schema=schema)

    return run


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes: bit k of word w of plane p is bit p of fingerprint 64 w + k."""
    padded = np.zeros(-(-len(prints) // 64) * 64, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def close_pairs(prints: np.ndarray, lows: np.ndarray, highs: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i ascending: fingerprint i and one at j in [lows[i], highs[i]) that differ in radius bits at most.

    A row is a fingerprint against a block of 64. Each of a row's counters has a bit in every digit; they start so that
    a counter overflows with the first bit beyond the radius, and what has overflowed stays out. Rows of which all has
    are abandoned.
    """
    planes, digits = planes_of(prints), radius.bit_length()
    start = (1 << digits) - 1 - radius
    probes = np.flatnonzero(highs > lows)
    first, blocks = lows[probes] >> 6, ((highs[probes] - 1) >> 6) - (lows[probes] >> 6) + 1
    ends = np.cumsum(blocks)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(ROWS, int(ends[-1]) if len(ends) else 0, ROWS)), len(probes)))
    for a, b in zip(np.append(0, cuts[:-1]), cuts):
        if a == b:
            continue
        row, block = np.repeat(probes[a:b], blocks[a:b]), _runs(first[a:b], blocks[a:b])
        low, high = np.clip(lows[row] - 64 * block, 0, 64).astype(np.uint64), np.clip(highs[row] - 64 * block, 0, 64).astype(np.uint64)
        below = lambda n: np.where(n == 64, _ALL, (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))
        over = ~(below(high) & ~below(low))
        counters = [np.full(len(row), _ALL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
        own = prints[row]
        for p in range(64):
            carry = planes[p][block] ^ (np.uint64(0) - (own >> np.uint64(p) & np.uint64(1)))
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            over |= carry
            if p >= FIRST_LOOK and p % NEXT_LOOK == 0:
                left = np.flatnonzero(over != _ALL)
                if len(left) < 0.75 * len(over):
                    row, block, own, over, counters = row[left], block[left], own[left], over[left], [c[left] for c in counters]
                    if not len(left):
                        break
        hit = np.flatnonzero(over != _ALL)
        if len(hit):
            at, bit = np.nonzero(np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[hit][at], block[hit][at] * 64 + bit


_LINKS = "a long, b long"


def _tiles(radius: int):
    schema = arrow_schema(_LINKS)

    def links(tile: np.ndarray, side: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of the links in each tile as many as join its fingerprints to components. tile: a number for each tile, ascending."""
        at = np.arange(len(prints))
        starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        sizes = np.diff(np.append(starts, len(tile)))
        begin, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        second = np.repeat(np.add.reduceat(side == 1, starts), sizes) + begin  # where the other side of a tile of two sides begins
        lows, highs = np.where(side == 0, at + 1, np.where(side == 1, second, end)), end
        root = at.copy()
        for i, j in close_pairs(prints.view(np.uint64), lows, highs, radius):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            groups = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for g, h in zip(groups.tolist(), np.append(groups[1:], len(i)).tolist()):
                me, others = int(i[g]), j[g:h]
                roots, first = np.unique(root[others], return_index=True)
                new = roots != root[me]
                if new.any():
                    for k in others[first[new]].tolist():
                        yield int(prints[me]), int(prints[k])
                    own = root[begin[me] : end[me]]
                    own[np.isin(own, roots)] = root[me]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come one after another: rows are sorted by (key, i, j, side)."""
        held: list[np.ndarray] = []

        def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            tile = np.cumsum(np.append(0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
            found = sorted({(min(x, y), max(x, y)) for x, y in links(tile, rows[:, 3], np.ascontiguousarray(rows[:, 4]))})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1))
            if sum(map(len, held)) >= TOGETHER:
                rows = np.concatenate(held)
                same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
                last = int(np.argmax(same))  # the last tile may go on
                if last:
                    yield from told(rows[:last])
                held = [rows[last:]]
        if held and sum(map(len, held)):
            yield from told(np.concatenate(held))

    return run


def near_links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), enough to join what differs in radius bits at most, between distinct fingerprints (column print).

    The 64 bits are parted into radius + 1 bands; two that link have a band in common. Fingerprints under one band meet
    as bit planes, in tiles of TILE fingerprints a side where there are many, so no band is too large for a task.
    """
    bands = radius + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    key = lambda k: F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("print", edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1)).alias("part"))
    rows = prints.select("print", F.explode(F.array(*[key(k) for k in range(bands)])).alias("k"))
    rows = rows.select("print", (F.col("k.part") * bands + F.col("k.band")).alias("key")) if radius else rows.select("print", F.col("k.part").alias("key"))
    rows = scratch.save(rows, "bands")
    parts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    place = lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), F.when(own == x, 0).when(own < x, 1).otherwise(2).alias("side"))
    met = beside_hot(rows, parts, "key", scratch).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), place)))
    met = met.select("key", "at.i", "at.j", "at.side", "print").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return scratch.save(met.mapInArrow(_tiles(radius), _LINKS).distinct(), "links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; fingerprint is 16 hexadecimal digits.

    Fingerprints that differ in radius bits at most link, whatever the texts; component_id is the least doc_id that can
    be reached. Documents of one fingerprint are one node, so a text copied by the million is compared once.

    A null or empty text has the fingerprint zero, which links like any other. A row without an id has a fingerprint,
    links with nothing and has a null component. Texts are read whole, however long. Repeated rows, and texts that share
    an id, are one row each. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "simhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))
    made = scratch.save(texts.mapInArrow(_prints(shingle), _PRINTS), "prints")
    nodes = scratch.save(made.groupBy("print").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(near_links(nodes.where("rep IS NOT NULL").select("print"), scratch, radius), scratch)
    groups = nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "rep", "root")
    least = groups.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "_root")
    groups = scratch.save(groups.join(least, F.col("root") == F.col("_root"), "left").select("print", F.coalesce("least", "rep").alias("component_id")), "groups")
    out = beside_hot(made, groups, "print", scratch)
    scratch.keep_only(out)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
