"""How the word frequencies of sources diverge: groups stay in seats, peers' packed vectors rotate past them round by round."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, arrow_schema, beside_hot, bound_batches, or_empty

#: Documents of a language that must have a term, parts that a frequency is told in, terms that are ranked for a group.
LEAST_DOCS, PARTS, TOP = 3, 1_000_000_000, 200
#: Terms, and numbers of all groups for them, of a slice of a language's vocabulary, about; groups of a block, at most.
SLICE, SLICE_NUMBERS, BLOCK = 1 << 15, 1 << 20, 8
#: Terms that a task counts before it passes them on.
HELD = 300_000

#: Bytes of terms, A-Z lowered: letters, and all of characters beyond ASCII. Others part terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode().translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents, of a task's terms by group; a group has a row without a term too."""
    schema, held, size = arrow_schema(_COUNTS), {}, 0
    seen: set[tuple[str, str]] = set()

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            items = list(n)
            if items:
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(items)), pa.repeat(source, len(items)), pa.array(items, pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in items], pa.int64())], schema=schema)

    for batch in batches:
        langs, sources, texts = (batch.column(k) for k in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            group = (lang, source)
            if group not in seen:
                seen.add(group)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((lang, source, None, 0, 0), schema.types)], schema=schema)
            if group not in held:
                held[group] = (Counter(), Counter())
            n, docs = held[group]
            words, before = terms_of(text.as_py()), len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > HELD:
                yield from told()
                held.clear()
                size = 0
        if len(seen) > HELD:
            seen.clear()
    yield from told()


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / (total + terms)), exactly: the quotient is made three digits at a time."""
    rest, whole, out = counts + 1, total + terms, np.zeros(len(counts), np.int64)
    part = rest // whole
    out, rest = part, rest - part * whole
    for _ in range(3):
        part, rest = divmod(rest * 1000, whole)
        out = out * 1000 + part
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of each term; shares lie below 2^31, so squares are exact."""
    d = p - q
    return d * d // q


_VECTORS = "lang string, slice int, source string, width int, places binary, counts binary, terms array<string>"
_VALUES = "lang string, source string, part string, item string, value long"


def _packed(x: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers from 0 on, in as many bytes as the largest needs; ascending ones by their steps; compressed."""
    x = np.diff(x, prepend=0) if steps else x
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    raw = x.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, steps: bool = False) -> np.ndarray:
    size = int.from_bytes(raw[1:9], "little")
    x = np.frombuffer(pa.decompress(raw[9:], size, codec="zstd", asbytes=True), f"<u{raw[0]}").astype(np.int64)
    return np.cumsum(x) if steps else x


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices come one after another, their rows by term: each group's numbers, packed with their places among the
    slice's terms, and in a row without a source the language's numbers and the terms."""
    schema, now, held = arrow_schema(_VECTORS), None, []

    def told() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).combine_chunks()
        terms, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        if isinstance(terms, pa.ChunkedArray):
            terms, sources = terms.combine_chunks(), sources.combine_chunks()
        place, own = terms.indices.to_numpy().astype(np.int64), sources.indices.to_numpy()
        n, width = rows.column("n").to_numpy(), len(terms.dictionary)
        every = np.zeros(width, np.int64)
        every[place] = rows.column("all").to_numpy()
        out = [(*now, None, width, None, _packed(every), terms.dictionary.to_pylist())]
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(sources.dictionary)))
        for source, part in zip(sources.dictionary.to_pylist(), np.split(order, ends[:-1])):
            out.append((*now, source, width, _packed(place[part], True), _packed(n[part]), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        starts = [k for k, key in enumerate(keys) if not k or key != keys[k - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if keys[a] != now:
                if held:
                    yield from told()
                now, held = keys[a], []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield from told()


def _best(p: np.ndarray, q: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the TOP terms that have more here than there, and what they add; of equal ones the first places."""
    over = np.flatnonzero((counts > 0) & (p > q))
    value = divergence(p[over], q[over])
    if len(over) > TOP:  # a heap of TOP: what lies below its least value is out, of that value the first places stay
        least = np.partition(value, len(value) - TOP)[len(value) - TOP]
        above, equal = np.flatnonzero(value > least), np.flatnonzero(value == least)
        kept = np.concatenate([above, equal[: TOP - len(above)]])
        over, value = over[kept], value[kept]
    return over, value


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seats come one after another: first the language's numbers, then the residents (round 0), then guests round by round.

    Residents rank their terms against the language, and each two groups that meet are compared both ways.
    """
    schema, seat, residents, language, terms = arrow_schema(_VALUES), None, [], None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["lang"], row["slice"], row["seat"]) != seat:
                seat, residents, language, terms = (row["lang"], row["slice"], row["seat"]), [], None, []
            numbers = np.zeros(row["width"], np.int64)
            if row["round"] < 0:
                language, terms = shares(_unpacked(row["counts"]), row["total"], row["vocabulary"]), row["terms"]
                continue
            if row["counts"] is not None:
                numbers[_unpacked(row["places"], True)] = _unpacked(row["counts"])
            source, p = row["source"], shares(numbers, row["total"], row["vocabulary"])
            for other, q in residents:
                out += [(row["lang"], source, "pair", other, int(divergence(p, q).sum())), (row["lang"], other, "pair", source, int(divergence(q, p).sum()))]
            if row["round"] == 0:
                residents.append((source, p))
                if language is not None:
                    out += [(row["lang"], source, "term", terms[k], v) for k, v in zip(*map(np.ndarray.tolist, _best(p, language, numbers)))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def rounds(block: Column, blocks: Column) -> Column:
    """Where a block of 0 .. blocks - 1 is a guest: an array of (round, seat).

    A tournament in which each block meets each other once: in round r, blocks meet whose numbers sum to r modulo an odd
    number, and the one that would meet itself meets the last. Of two that meet, one stays in its seat and the other visits.
    """
    n = (blocks + blocks % 2).cast("int")  # with an odd number of blocks one has no peer in a round
    odd = n - 1

    def meets(r: Column) -> Column:
        peer = F.when(block == odd, F.pmod(r * (n / 2).cast("int"), odd)).when(F.pmod(block * 2, odd) == F.pmod(r, odd), odd).otherwise(F.pmod(r - block, odd))
        return F.struct(r.alias("round"), peer.cast("int").alias("seat"))

    every = F.transform(F.sequence(F.lit(1), odd), meets)
    return F.filter(every, lambda m: (m["seat"] < blocks) & F.when((block + m["seat"]) % 2 == 0, m["seat"] < block).otherwise(m["seat"] > block))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's terms diverge from its peers' and from its language's.

    Part `pair` has each other source of the language and the divergence from it over all kept terms, part `term` the
    TOP terms that a source has more of than its language, by what they add. Terms are runs of letters, A-Z lowered; a
    language keeps those in LEAST_DOCS of its documents or more.

    Tasks count terms by group; one shuffle by term gives each term's sums in its language too. A vocabulary is dealt
    into slices of some SLICE terms, and a language's groups into blocks of BLOCK. A seat holds a block's vectors in one
    slice; the packed vectors of other blocks pass it in the rounds of a tournament, and each meeting gives both
    directions. So a task holds one block and one guest, whatever the number of groups, and a source with a third of
    all text is as long as any other: one number for each kept term. A seat keeps the TOP terms of each resident in its
    slice, and those are ranked once more.

    A null text, lang or source counts as ''; a group without kept terms has its pairs, and no terms. Repeated rows
    count as often as they stand there; ids are not read. Texts are read whole, however long. A language of one source
    has no pairs. Ties go to the lesser item by its UTF-8. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "divergence")
    texts = docs.select(or_empty("lang").alias("lang"), or_empty("source").alias("source"), or_empty("text").alias("text"))
    counts = texts.mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    counts = counts.withColumn("all", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    counts = scratch.save(counts.where(F.col("term").isNull() | (F.col("in_docs") >= LEAST_DOCS)).drop("docs", "in_docs"), "counts")
    entries = counts.where("term IS NOT NULL")

    # rows of groups, and of languages: few beside the entries
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("numbers"), F.sum(F.when(F.col("term").isNotNull() & F.col("first"), F.col("all"))).alias("all"), F.count_if(F.col("term").isNotNull() & F.col("first")).alias("terms"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sums = scratch.save(sums.withColumn("block", F.floor(number / BLOCK).cast("int")), "sums")
    langs = sums.groupBy("lang").agg(F.max("block").alias("last"), F.sum("terms").alias("vocabulary"), F.coalesce(F.sum("all"), F.lit(0)).cast("long").alias("all_total"), F.sum("numbers").alias("numbers"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / SLICE), F.ceil(F.col("numbers") / SLICE_NUMBERS)).cast("int")
    langs = scratch.save(langs.select("lang", (F.col("last") + 1).alias("blocks"), "vocabulary", "all_total", slices.alias("slices")), "langs")

    dealt = beside_hot(entries.select("lang", "source", "term", "n", "all"), langs.select("lang", "slices"), "lang", scratch).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    dealt = dealt.select("lang", "slice", "term", "source", "n", "all").repartition("lang", "slice").sortWithinPartitions("lang", "slice", "term")
    vectors = scratch.save(dealt.mapInArrow(_vectors, _VECTORS), "vectors")

    # every group has a row in every slice, and the language's row goes to every seat of its slice
    every = sums.select("lang", "source", "total", "block").join(langs, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    widths = vectors.where("source IS NULL").select("lang", "slice", F.col("width").alias("_width"))
    own = every.join(vectors.where("source IS NOT NULL").drop("width", "terms"), ["lang", "slice", "source"], "left").join(widths, ["lang", "slice"], "left")
    home = F.array(F.struct(F.lit(0).alias("round"), F.col("block").alias("seat")))
    own = own.withColumn("_at", F.explode(F.concat(home, rounds(F.col("block"), F.col("blocks")))))
    columns = ["lang", "slice", "seat", "round", "source", "total", "vocabulary", "width", "places", "counts", "terms"]
    own = own.select("lang", "slice", "_at.*", "source", "total", "vocabulary", F.coalesce("_width", F.lit(0)).alias("width"), "places", "counts", F.lit(None).cast("array<string>").alias("terms"))
    whole = vectors.where("source IS NULL").join(langs, "lang").withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("round", F.lit(-1)).withColumn("total", F.col("all_total"))
    seated = own.select(*columns).unionByName(whole.select(*columns))
    met = seated.repartition("lang", "slice", "seat").sortWithinPartitions("lang", "slice", "seat", "round", "source").mapInArrow(_meetings, _VALUES)
    values = met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))

    ranks = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    out = values.withColumn("rank", ranks).where(F.expr(f"part = 'pair' OR rank <= {TOP}"))
    scratch.keep_only(out)
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
