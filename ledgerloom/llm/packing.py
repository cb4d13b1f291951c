"""Packing documents into windows: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, content_order, or_empty, rows_of, running_sums, with_bins
from .tokens import as_binary, encoder, ends_after, id_type

WINDOW = 2048
#: Lengths are rounded up to multiples of BIN for the least squares; a combination has DEPTH lengths at most.
BIN, DEPTH = 32, 4
#: A window may stay so many tokens short; what fits no window so well is packed by cutting.
SLACK = 16


def combinations(total: int, depth: int, least: int = 1, most: int | None = None) -> Iterator[tuple[int, ...]]:
    """Non-increasing tuples of at most depth positive integers that sum to total."""
    most = min(total, most or total)
    if depth == 1:
        if least <= total <= most:
            yield (total,)
        return
    for first in range(most, least - 1, -1):
        if first == total:
            yield (first,)
        elif first * depth >= total:
            yield from ((first, *rest) for rest in combinations(total - first, depth - 1, least, first))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with a x near b in least squares, by active sets: columns enter by gradient and leave at zero.

    It ends at the least squares; only if rounding makes sets recur does it end after rounds, three for each column,
    with an x that is still feasible.
    """
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds or 3 * n):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        enter = int(np.argmax(slope))
        if slope[enter] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        free[enter] = True
        while True:
            at = np.flatnonzero(free)
            goal = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (goal > 0).all():
                x = np.zeros(n)
                x[at] = goal
                break
            down = goal <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - goal[down], 1e-300))
            x[at] += min(1.0, max(0.0, step)) * (goal - x[at])
            x[at[down & (x[at] <= 1e-9)]] = 0.0
            gone = at[x[at] <= 1e-9]
            if not len(gone):
                break
            free[gone] = False
            x[gone] = 0.0
    return x


@dataclass
class Plan:
    """Where the remainders of documents go: those of a length stand in line, and each line is dealt out in segments."""

    #: length -> list of (first place in line, how many, first sequence, offset there)
    segments: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    #: length -> (first place in line that is packed by cutting, tokens before it in that stream)
    cut: dict[int, tuple[int, int]] = field(default_factory=dict)
    sequences: int = 0


def plan(histogram: dict[int, int], window: int = WINDOW, step: int = BIN, depth: int = DEPTH, slack: int = SLACK) -> Plan:
    """Deals a histogram of lengths below the window into sequences.

    Least squares gives how often each combination of rounded lengths is to be repeated. A combination is filled with
    real lengths, the last chosen to leave the least room, and repeated as often as all of them last; so each pattern
    uses up a length or its count, and there are few patterns however many documents there are. What is left is packed
    greedily, longest first, as long as windows fill up to the slack. The rest is laid end to end and cut at windows.
    """
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    used: Counter[int] = Counter()
    out = Plan()

    def emit(lengths: list[int], times: int) -> None:
        at = 0
        for length in lengths:
            out.segments[length].append((used[length], times, out.sequences, at))
            used[length] += times
            left[length] -= times
            at += length
        out.sequences += times

    def lasting(lengths: list[int]) -> int:
        return min(left[k] // n for k, n in Counter(lengths).items())

    def best(top: int, taken: list[int], low: int = 1) -> int:
        """The longest length of at most top that is left."""
        own = Counter(taken)
        return next((k for k in range(top, low - 1, -1) if left[k] - own[k] > 0), 0)

    if left:
        bins = window // step
        counts = np.zeros(bins + 1)
        for k, n in left.items():
            counts[-(-k // step)] += n
        combos = [c for c in combinations(bins, depth) if all(counts[b] for b in set(c))]
        if combos:
            a = np.zeros((bins + 1, len(combos)))
            for j, c in enumerate(combos):
                for b in c:
                    a[b, j] += 1
            wanted = np.floor(nnls(a, counts) + 0.5).astype(int)
            for j in np.argsort(-wanted, kind="stable"):
                need = int(wanted[j])
                while need > 0:
                    lengths: list[int] = []
                    for b in combos[j][:-1]:
                        own = Counter(lengths)
                        lengths.append(max(range((b - 1) * step + 1, b * step + 1), key=lambda k: left[k] - own[k] if k < window else 0))
                    if len(combos[j]) > 1 and min((left[k] - n for k, n in Counter(lengths).items()), default=0) < 0:
                        break
                    last = best(min(window - 1, window - sum(lengths)), lengths, (combos[j][-1] - 1) * step + 1)
                    if not last:
                        break
                    lengths.append(last)
                    if window - sum(lengths) > slack and (more := best(window - sum(lengths), lengths)):
                        lengths.append(more)
                    times = min(need, lasting(lengths))
                    if times <= 0 or window - sum(lengths) > slack:
                        break
                    emit(lengths, times)
                    need -= times
        while (first := best(window - 1, [])):
            lengths = [first]
            while (more := best(window - sum(lengths), lengths)):
                lengths.append(more)
            if window - sum(lengths) > slack:
                break
            emit(lengths, max(1, lasting(lengths)))
    tokens = 0
    for k in sorted(left, reverse=True):
        if left[k] > 0:
            out.cut[k] = (used[k], tokens)
            tokens += left[k] * k
    return out


_TOKENS = "uid long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _tokenize(tokenizer: str, end_id: int, dtype: str):
    schema = arrow_schema(_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            docs, at = batch.column("doc_id"), 0
            for ids, sizes in own.encode_all(batch.column("text")):
                ids, sizes = ends_after(ids, sizes, end_id, dtype)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(made, made + n)), docs.slice(at, n), pa.array(sizes), as_binary(ids, sizes)], schema=schema)
                made, at = made + n, at + n

    return run


def _cut(plan: Plan, base: dict[int, int], first_mixed: int, window: int, with_ids: bool, dtype: str):
    """base: remainder -> first sequence of the whole windows of documents with that remainder."""
    schema = arrow_schema(_PIECES)
    segments = {k: (np.array([s[0] for s in v]), v) for k, v in plan.segments.items()}
    first_cut = first_mixed + plan.sequences

    def places(length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of a remainder."""
        if length in plan.cut and rank >= plan.cut[length][0]:
            start, before = plan.cut[length]
            at, out = before + (rank - start) * length, []
            while length:
                take = min(length, window - at % window)
                out.append((take, first_cut + at // window, at % window))
                at, length = at + take, length - take
            return out
        starts, own = segments[length]
        first, _, sequence, offset = own[int(np.searchsorted(starts, rank, side="right")) - 1]
        return [(length, first_mixed + sequence + rank - first, offset)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sizes, rests, ranks, wholes, raws in rows_of(batches, "doc_id", "n", "rest", "rank", "wholes", "ids", rows=256):
            out: list[tuple] = []
            for doc, n, rest, rank, whole, raw in zip(docs, sizes, rests, ranks, wholes, raws):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                pieces = [(window, base[rest] + whole + k, 0) for k in range(n // window)]
                pieces += places(rest, rank) if rest else []
                at = 0
                for length, sequence, offset in pieces:
                    own = ids[at : at + length]
                    out.append((doc, at, length, zlib.crc32(own.tobytes()), n, sequence, offset, own.tolist() if with_ids else None))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most window tokens; a row for each piece of a document.

    Returns doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset and
    with with_ids the ids. A document is cut into whole windows and one remainder; remainders go by plan() over the
    histogram of their lengths, which has fewer entries than the window whatever the number of documents. Only windows
    that end short are padded. A null text is empty and packs its end id; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored. A very long text is encoded whole and cut into its windows by one task. Ids
    are held in 16 bits if all of the vocabulary's fit, else in 32.
    """
    bound_batches(docs.sparkSession)
    dtype = id_type(tokenizer, end_id)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))
    tokens = scratch.save(rows.mapInArrow(_tokenize(tokenizer, end_id, dtype), _TOKENS), "tokens")
    lines = tokens.select("uid", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).cast("long").alias("_whole"), F.lit(1).alias("_one"))
    histogram = lines.groupBy("rest").agg(F.count("*").alias("rows"), F.sum("_whole").alias("wholes")).orderBy("rest").collect()
    base, sequences = {}, 0
    for r in histogram:
        base[r["rest"]] = sequences
        sequences += r["wholes"]
    dealt = plan({r["rest"]: r["rows"] for r in histogram if r["rest"]}, window)
    lines = with_bins(lines.withColumn("_order", content_order(F.col("uid"))), "_order")
    lines = running_sums(lines, ["rest"], ["_order", "uid"], {"rank": "_one", "wholes": "_whole"})
    joined = tokens.join(lines.select("uid", "rest", "rank", "wholes"), "uid").select("doc_id", "n", "rest", "rank", "wholes", "ids")
    out = joined.mapInArrow(_cut(dealt, base, sequences, window, with_ids, dtype), _PIECES)
    return out if with_ids else out.drop("ids")
