"""Language-model scores by partial matching: byte contexts with escapes and symbol exclusion."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, or_empty, rows_of
from .tokenbin import _mapped, _Out
from .toxicity import held_out

#: Bytes of context.
ORDER = 5
#: Contexts of up to so many bytes are few at any size of the corpus: they go to all tasks, longer ones are joined.
LOW = 2
#: Never a byte of UTF-8: it pads the context of a text's start, and as a symbol it ends the text.
END = 0xFF
#: The symbols: 256 bytes, of which END is the end.
SYMBOLS = 256
#: Every HELD_OUT-th document by crc32 of its id is never learned from.
HELD_OUT = 10
#: A word with this part of all training tokens is frequent; there are at most 1 / FREQUENT of them.
FREQUENT = 1 / 8192
#: The token that ends a text; no word holds white space.
END_TOKEN = b"\n"
#: Places to which the base score is rounded: its terms are summed in any order.
SHOWN = 9
#: Bytes taken from a text in one go.
STEP = 1 << 18
#: Runs of bytes that a task holds before it sorts them.
HELD = 1 << 21
#: Marks runs of documents that are never learned from.
_APART = 1 << 62


def _low_bytes(n: int) -> int:
    return (1 << 8 * n) - 1


def _runs(raw: bytes) -> Iterator[np.ndarray]:
    """All runs of ORDER + 1 bytes of a text, each as a number, STEP at a time."""
    seq = np.frombuffer(b"\xff" * ORDER + raw + b"\xff", np.uint8)
    for at in range(0, len(seq) - ORDER, STEP):
        part = seq[at : at + STEP + ORDER].astype(np.int64)
        n = len(part) - ORDER
        key = np.zeros(n, np.int64)
        for k in range(ORDER + 1):
            key = (key << 8) | part[k : k + n]
        yield key


def _dense(offsets: np.ndarray, symbols: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """counts[k, symbol] of the lists of these rows; no counts for a row of -1."""
    out = np.zeros((len(rows), SYMBOLS))
    first = np.where(rows < 0, 0, offsets[rows])
    size = np.where(rows < 0, 0, offsets[rows + 1] - first)
    at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    out[np.repeat(np.arange(len(rows)), size), symbols[at]] = n[at]
    return out


def escaped(orders: list[np.ndarray]) -> np.ndarray:
    """logs[context, symbol]: log10 of each symbol's probability, from counts[context, symbol] of ORDER to 0 bytes of context.

    A context with n symbols seen, d of them distinct, gives a seen one (its count - 1/2) / n and escapes with d / 2n
    to the shorter context, in which the symbols already seen are left out; below the empty context all symbols not yet
    seen are alike.
    """
    logs, out, escape = np.zeros(orders[0].shape), np.zeros(orders[0].shape, bool), np.zeros(len(orders[0]))
    for c in orders:
        c = np.where(out, 0.0, c)
        n, d, seen = c.sum(1), (c > 0).sum(1), c > 0
        row, _ = np.nonzero(seen)
        logs[seen] = escape[row] + np.log10((2 * c[seen] - 1) / (2 * n[row]))
        some = n > 0
        escape[some] += np.log10(d[some] / (2 * n[some]))
        out |= seen
    rest = SYMBOLS - out.sum(1)
    return np.where(out, logs, (escape - np.log10(np.maximum(rest, 1)))[:, None])


def plain(text: str) -> bytes:
    """A text as its tokens: A-Z in lower case, one blank between words."""
    return b" ".join(text.encode().lower().split())


_COUNTS = "word binary, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of runs of ORDER + 1 bytes in a task's texts; runs of texts not learned from count 0."""
    schema = arrow_schema(_COUNTS)
    words, grams, size, docs = Counter(), [], 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        """Sorts what has come and adds it to what was counted before."""
        nonlocal grams, size, held
        if grams:
            found, n = np.unique(np.concatenate(grams), return_counts=True)
            held.append((found, n))
            grams, size = [], 0
        if len(held) > 8:
            held = [merged(held)]

    def merged(parts):
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, n).astype(np.int64)

    def told():
        keys = list(words)
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([words[k] for k in some], pa.int64())], schema=schema)

    for texts, apart in rows_of(batches, "text", "apart", rows=512):
        for text, out in zip(texts, apart):
            raw = plain(text)
            if not out:
                words.update(raw.split(b" ") if raw else ())
                docs += 1
            for key in _runs(raw):
                grams.append(key | _APART if out else key)
                size += len(key)
                if size > HELD:
                    fold()
        if len(words) > 400_000:
            yield from told()
            words = Counter()
    if docs:
        words[END_TOKEN] += docs
    yield from told()
    fold()
    if held:
        found, n = merged(held)
        n[found >= _APART] = 0
        found &= ~np.int64(_APART)
        for at in range(0, len(found), 100_000):
            some = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(n[at : at + 100_000])], schema=schema)


def _contexts(grams: DataFrame) -> DataFrame:
    """(context, symbols, n): the symbols behind each context and their counts."""
    lists = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.collect_list(F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")).alias("e"))
    return lists.select("context", F.col("e.symbol").alias("symbols"), F.col("e.n").alias("n"))


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """Counts of runs of order + 1 bytes out of those of longer ones."""
    return grams.groupBy(F.col("gram").bitwiseAND(F.lit(_low_bytes(order + 1))).alias("gram")).agg(F.sum("n").alias("n"))


def _low(grams: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, offsets, symbols, counts) for LOW to 0 bytes of context, out of runs of LOW + 1 bytes."""
    key, n, out = grams.column("gram").to_numpy(), grams.column("n").to_numpy(), []
    for order in range(LOW, -1, -1):
        key, at = np.unique(key & _low_bytes(order + 1), return_inverse=True)
        n = np.bincount(at, n, minlength=len(key))
        contexts, first = np.unique(key >> 8, return_index=True)
        out.append((contexts, np.append(first, len(key)), key & 255, n))
    return out


_LOGS = "gram long, log double"


def _new(low):
    schema = arrow_schema(_LOGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs that no training document has, by the shorter contexts."""
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch, orders = whole.slice(at, 2048), []
                context = batch.column("context").to_numpy()
                every = np.arange(len(context))
                for order in range(ORDER, LOW, -1):
                    symbols, n = batch.column(f"symbols{order}"), batch.column(f"n{order}")
                    size = np.array(symbols.value_lengths().fill_null(0))
                    orders.append(_dense(np.append(0, np.cumsum(size)), symbols.flatten().to_numpy(), n.flatten().to_numpy(), every))
                for order, (contexts, offsets, symbols, n) in zip(range(LOW, -1, -1), low.value):
                    own = context & _low_bytes(order)
                    place = np.searchsorted(contexts, own)
                    found = contexts[np.minimum(place, len(contexts) - 1)] == own if len(contexts) else np.zeros(len(own), bool)
                    orders.append(_dense(offsets, symbols, n, np.where(found, place, -1)) if len(contexts) else np.zeros((len(own), SYMBOLS)))
                symbols, n = batch.column(f"symbols{ORDER}"), batch.column(f"n{ORDER}").flatten().to_numpy()
                row = np.repeat(every, np.array(symbols.value_lengths()))[n == 0]
                symbol = symbols.flatten().to_numpy()[n == 0]
                yield pa.RecordBatch.from_arrays([pa.array((context[row] << 8) | symbol), pa.array(escaped(orders)[row, symbol])], schema=schema)

    return run


_PARTS = "path string, first long, size long"


def _writer(root: str):
    schema = arrow_schema(_PARTS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, first, size = f"{root}/part-{TaskContext.get().partitionId():06d}", None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            if out is None:
                out, first = {x: _Out(f"{path}.{x}") for x in ("gram", "log")}, int(gram[0])
            out["gram"].write(gram.astype("<i8"))
            out["log"].write(batch.column("log").to_numpy().astype("<f4"))
            size += len(gram)
        if out is not None:
            for f in out.values():
                f.done()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "size": [size]}, schema=schema)

    return write


def write_logs(grams: DataFrame, scratch: Scratch) -> list[tuple[int, str]]:
    """Writes log10 of the probability of every run's last byte behind the others; gives (first run, path) of the parts.

    grams: all runs (gram) of all documents with their counts (n) in those learned from. The parts are ranges of runs;
    .gram has the runs in order, .log their logarithms. No context is left out. Where a run was seen its longest
    context decides; the others are joined with their shorter contexts, one row for each context that has such a run.
    """
    spark = grams.sparkSession
    longest = scratch.save(_contexts(grams), "contexts")
    seen, new = grams.where("n > 0"), longest.where(F.exists("n", lambda n: n == 0)).select("context", F.col("symbols").alias(f"symbols{ORDER}"), F.col("n").alias(f"n{ORDER}"))
    for order in range(ORDER - 1, LOW, -1):
        seen = scratch.save(_shorter(seen, order), "seen")
        own = _contexts(seen).select(F.col("context").alias("_own"), F.col("symbols").alias(f"symbols{order}"), F.col("n").alias(f"n{order}"))
        new = new.join(own, F.col("context").bitwiseAND(F.lit(_low_bytes(order))) == F.col("_own"), "left").drop("_own")
    low = spark.sparkContext.broadcast(_low(_shorter(seen, LOW).toArrow()))
    new = scratch.save(new.mapInArrow(_new(low), _LOGS), "new")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)
    known = longest.select("context", total.alias("total"), F.explode(F.arrays_zip("symbols", "n")).alias("e")).where("e.n > 0")
    known = known.select((F.shiftleft("context", 8) + F.col("e.symbols")).alias("gram"), F.log10((2 * F.col("e.n") - 1) / (2 * F.col("total"))).alias("log"))
    logs = known.unionByName(new).repartitionByRange("gram").sortWithinPartitions("gram")
    parts = scratch.save(logs.mapInArrow(_writer(f"{scratch.root}/logs"), _PARTS), "parts").orderBy("first").collect()
    return [(r["first"], r["path"]) for r in parts]


class Logs:
    """What write_logs() wrote, memory-mapped."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.first = np.array([f for f, _ in parts], np.int64)
        self.files = [(_mapped(f"{p}.gram", "<i8"), _mapped(f"{p}.log", "<f4")) for _, p in parts]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The logarithms of runs, given in any order."""
        found, at = np.unique(grams, return_inverse=True)
        cuts, out = [*np.searchsorted(found, self.first).tolist(), len(found)], np.empty(len(found))
        for (keys, logs), a, b in zip(self.files, cuts, cuts[1:]):
            if a < b:
                place = np.searchsorted(keys, found[a:b])
                if place[-1] >= len(keys) or (keys[place] != found[a:b]).any():
                    raise ValueError("a run of bytes was not counted")
                out[a:b] = logs[place]
        return out[at]


_LIGHT = "word binary, rows array<long>"
#: Occurrences that a task lists by word before it passes them on.
LISTED = 1_000_000


def _light(frequent: set[bytes]):
    schema = arrow_schema(_LIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word that isn't frequent the rows it occurs in, once for each occurrence."""
        lists: dict[bytes, list[int]] = defaultdict(list)
        size = 0

        def told():
            keys = list(lists)
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield pa.RecordBatch.from_pydict({"word": some, "rows": [lists[k] for k in some]}, schema=schema)

        for keys, texts in rows_of(batches, "_row", "text", rows=512):
            for key, text in zip(keys, texts):
                words = [w for w in text.encode().lower().split() if w not in frequent]
                for w in words:
                    lists[w].append(key)
                size += len(words)
            if size > LISTED:
                yield from told()
                lists, size = defaultdict(list), 0
        yield from told()

    return run


_SCORES = "_row long, doc_id long, n_tokens long, often double, often_known long, score double"


def _score(parts: list[tuple[int, str]], frequent: dict[bytes, float]):
    schema = arrow_schema(_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = Logs(parts)
        for keys, ids, texts in rows_of(batches, "_row", "doc_id", "text", rows=512):
            out, scores, grams, owner, size = [], np.zeros(len(keys)), [], [], 0
            for k, (key, doc, text) in enumerate(zip(keys, ids, texts)):
                raw = plain(text)
                words = raw.split(b" ") if raw else []
                often = [frequent[w] for w in words if w in frequent]
                out.append((key, doc, len(words) + 1, float(sum(often)), len(often)))
                for run_ in _runs(raw):
                    grams.append(run_)
                    owner.append(k)
                    size += len(run_)
                    if size > HELD:
                        _add(scores, logs, grams, owner)
                        grams, owner, size = [], [], 0
            _add(scores, logs, grams, owner)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), schema.types)), pa.array(scores)], schema=schema)

    return run


def _add(scores: np.ndarray, logs: Logs, grams: list[np.ndarray], owner: list[int]) -> None:
    if grams:
        first = np.cumsum([0, *map(len, grams[:-1])])
        np.add.at(scores, owner, np.add.reduceat(logs.of(np.concatenate(grams)), first))


def scored(docs: DataFrame) -> DataFrame:
    """Scores all documents by a model of the training documents, beside a unigram score of their words.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Words and runs of bytes are counted
    over all training documents, the latter in texts as their tokens with one blank between. Every context counts; the
    probabilities of all runs that documents have lie in sorted files in the shared folder, which tasks map. Of the words
    only the frequent ones go to all tasks, the counts of all others meet the words of documents in a join on the word,
    which no word dominates. A null text is empty and has the end alone; a null id counts as empty text for the split;
    very long texts are counted and scored a stretch at a time; repeated rows are scored each; an empty table gives no
    rows; other columns are ignored; without training documents the base score is 0 and bytes are alike.
    """
    scratch = Scratch(docs.sparkSession, "ppm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))
    out = held_out(F.col("doc_id"), HELD_OUT)
    counts = rows.select("text", out.alias("apart")).mapInArrow(_count, _COUNTS).groupBy("word", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    words, grams = counts.where("word IS NOT NULL").select("word", F.col("n").alias("c")), counts.where("gram IS NOT NULL").select("gram", "n")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = words.where((F.col("c") >= FREQUENT * total) & (F.col("word") != F.lit(END_TOKEN))).collect() if total else []
    frequent = {bytes(r["word"]): float(np.log10(r["c"] + 0.1)) for r in often}
    parts = write_logs(grams, scratch)

    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text"))
    light = rows.select("_row", "text").mapInArrow(_light(set(frequent)), _LIGHT)
    light = light.join(words.where(F.col("word") != F.lit(END_TOKEN)), "word", "left").select(F.coalesce("c", F.lit(0)).alias("c"), F.explode("rows").alias("_row"))
    light = light.groupBy("_row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("rare"), F.count_if(F.col("c") > 0).alias("rare_known"))
    scores = scratch.save(rows.select("_row", "doc_id", "text").mapInArrow(_score(parts, frequent), _SCORES), "scores")
    scores = scores.join(scores.groupBy("_row").agg(F.count("*").alias("copies")), "_row").join(light, "_row", "left")
    # every text has one end; lists have the words of all copies of a row
    end = words.where(F.col("word") == F.lit(END_TOKEN)).first()
    ends = end["c"] if end else 0
    per_copy = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    base = F.col("often") + per_copy("rare") + F.lit(float(np.log10(ends + 0.1))) - F.col("n_tokens") * F.lit(float(np.log10(total + 0.1 * (distinct + 1))))
    return scores.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("often_known") + per_copy("rare_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.round(base, SHOWN).alias("base_score"), "score",
    )
