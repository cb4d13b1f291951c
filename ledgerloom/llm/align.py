"""Alignment of two tokenizers: packed bitsets of token ends give shared cuts, groups of tokens, and links of token pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, or_empty
from .tokens import _LETTERS, Encoder, _offsets, _runs

#: Units of text whose pieces a worker keeps; when there are more it starts anew.
KEPT = 200_000
#: Bytes of text whose links are counted as one block.
BLOCK_BYTES = 12 << 20
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}+[^{_SPACE}]*")


class ByteEncoder(Encoder):
    """A byte-level vocabulary; the strings of its special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = ""
        letters = {chr(c): b for b, c in _LETTERS.items()}
        n = self.tokenizer.get_vocab_size()
        spelt = [self.tokenizer.id_to_token(k) or "" for k in range(n)]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in spelt]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many to each text)."""
        parts = list(self.encode_all(texts))
        return np.concatenate([np.empty(0, np.uint32), *(i for i, _ in parts)]), np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])


class PieceEncoder:
    """A vocabulary of pieces with byte fallback, which puts a space before each text.

    No piece runs from other characters into a space, so units of spaces and what follows them encode alone; the
    distinct units of a batch are encoded together. A vocabulary where that doesn't hold goes through the library whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.kept = SentencePieceProcessor(model_file=path), {}
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.alone = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and self.model.encode("a  b ") == [k for u in ("a", " b") for k in self.model.encode(u)] + [self.model.piece_to_id(_SPACE)]
        self.kept = {}

    def plain(self, text: str) -> np.ndarray:
        """The ids by the library."""
        return np.array(self.model.encode(text, num_threads=1), np.uint32)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many to each) of what follows the first space of units."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        new = [u for u in units if u not in kept]
        if new:
            kept.update((u, np.array(ids, "<u4").tobytes()) for u, ids in zip(new, self.model.encode(new, num_threads=1)))
            kept[""] = np.array([self.model.piece_to_id(_SPACE)], "<u4").tobytes()
        made = [kept[u] for u in units]
        return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many to each text); an empty text has none."""
        whole = pc.match_substring(texts, _SPACE).to_numpy(zero_copy_only=False) if self.alone else np.ones(len(texts), bool)
        odd = pc.match_substring_regex(texts, r"^ |  | \z").to_numpy(zero_copy_only=False) & ~whole
        none = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        sizes, starts, pools, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        usual = np.flatnonzero(~(whole | odd | none))
        if len(usual):
            words = pc.split_pattern(texts.take(pa.array(usual)), " ")
            coded = words.flatten().dictionary_encode()
            ids, lengths = self._units(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy()
            ends = np.append(0, np.cumsum(lengths[at]))[_offsets(words)]
            pools.append(ids[_runs((np.cumsum(lengths) - lengths)[at], lengths[at])])
            sizes[usual], starts[usual], size = np.diff(ends), ends[:-1], int(ends[-1])
        for k in np.flatnonzero((whole | odd) & ~none).tolist():
            text = texts[k].as_py()
            if whole[k]:
                own = self.plain(text)
            else:
                own = self._units([u[1:].replace(_SPACE, " ") for u in _UNIT.findall(_SPACE + text.replace(" ", _SPACE))])[0]
            pools.append(own)
            starts[k], sizes[k], size = size, len(own), size + len(own)
        ids = np.concatenate([np.empty(0, np.uint32), *pools]).astype(np.uint32)
        return ids[_runs(starts, sizes)], sizes


_encoders: dict[tuple[type, str], object] = {}


def _encoder(kind: type, path: str):
    """The worker's encoder for a file."""
    if (kind, path) not in _encoders:
        made = kind(path)
        made.lengths = np.fromiter(map(len, made.bytes), np.int64, len(made.bytes))
        _encoders[kind, path] = made
    return _encoders[kind, path]


class Bitset:
    """Places in a run of bytes, one bit each, with counts of the bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bitset:
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[places] = True
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, below = places >> 6, (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self) -> np.ndarray:
        """The places of all set bits, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """The tokens of a batch of texts, aligned: all texts in one run of bytes.

    a, b: the ids; doc_a, doc_b: where each text's ids begin, and the end. cuts: last bytes of groups; group_a, group_b:
    the first id behind each; doc_cuts: where each text's cuts begin. link_a, link_b: the places of linked ids;
    doc_links: where each text's links begin.
    """

    def __init__(self, texts: pa.Array, a: ByteEncoder, b: PieceEncoder):
        spaced = pc.binary_join_element_wise(" ", texts, "")
        size = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        (self.a, n_a), (self.b, n_b) = a.tokens(spaced), b.tokens(texts)
        kept = (size > 1) & _spells(self.a, n_a, a, spaced, size) & _spells(self.b, n_b, b, spaced, size)
        self.a, self.b = self.a[np.repeat(kept, n_a)], self.b[np.repeat(kept, n_b)]
        n_a, n_b, size = n_a * kept, n_b * kept, size * kept
        self.doc_a, self.doc_b, ends = (np.append(0, np.cumsum(n)) for n in (n_a, n_b, size))
        total = int(ends[-1])
        of_a, of_b = (Bitset.of(np.cumsum(e.lengths[ids]) - 1, total) for e, ids in ((a, self.a), (b, self.b)))
        self.cuts = Bitset(of_a.words & of_b.words).select()
        self.group_a, self.group_b = of_a.rank(self.cuts) + 1, of_b.rank(self.cuts) + 1
        # a stretch between neighbouring ends of either kind lies in one token of each, and each pair that overlaps has one
        stretches = Bitset(of_a.words | of_b.words).select()
        self.link_a, self.link_b = of_a.rank(stretches), of_b.rank(stretches)
        self.doc_cuts, self.doc_links, self.doc_bytes = np.searchsorted(self.cuts, ends), np.searchsorted(stretches, ends), ends

    def told(self, strings: Strings) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2, without tokens an empty string."""
        # in the string a's id stands behind the b ids of earlier groups, b's id behind the a ids up to its group
        in_a, in_b = np.diff(np.append(0, self.group_a)), np.diff(np.append(0, self.group_b))
        at_a = np.arange(len(self.a)) + np.repeat(np.append(0, self.group_b)[:-1], in_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.group_a, in_b)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[at_a], codes[at_b] = strings.a(self.a), strings.b(self.b)
        codes[at_a[self.group_a - 1]] += 1
        codes[at_b[self.group_b - 1]] += 1
        out, spelt = [], strings.all
        ends = self.doc_a + self.doc_b
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out.append("".join([spelt[c] for c in codes[x:y].tolist()])[:-1])
        return out


class Strings:
    """Ids in decimal with what follows them: a comma, or | behind a group's last a and ; behind its last b."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        self.all = [f"{k}{end}" for n, last in ((n_a, "|"), (n_b, ";")) for k in range(n) for end in (",", last)]

    def a(self, ids: np.ndarray) -> np.ndarray:
        return ids.astype(np.int64) * 2

    def b(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.int64) + self.n_a) * 2


def _spells(ids: np.ndarray, sizes: np.ndarray, encoder, texts: pa.Array, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text's."""
    joined = b"".join([encoder.bytes[k] for k in ids.tolist()])
    whole = b"".join(pc.cast(texts, pa.binary()).to_pylist())
    if joined == whole and len(joined) == int(length.sum()):
        own = np.append(0, np.cumsum(encoder.lengths[ids]))[np.append(0, np.cumsum(sizes))]
        return np.diff(own) == length
    ends, own = np.append(0, np.cumsum(length)), np.append(0, np.cumsum(encoder.lengths[ids]))[np.append(0, np.cumsum(sizes))]
    return np.array([joined[p:q] == whole[x:y] for p, q, x, y in zip(own[:-1], own[1:], ends[:-1], ends[1:])], bool)


_GROUPS = "doc_id long, a array<int>, b array<int>, ends array<long>, a_ends array<int>, b_ends array<int>"


def _grouped(path_a: str, path_b: str):
    schema = arrow_schema(_GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _encoder(ByteEncoder, path_a), _encoder(PieceEncoder, path_b)
        for batch in batches:
            x = Alignment(_strings(batch.column(1)), a, b)
            lists = lambda values, at, type_: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, type_))
            less = lambda values, doc: values - np.repeat(doc[:-1], np.diff(x.doc_cuts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(x.a, x.doc_a, pa.int32()), lists(x.b, x.doc_b, pa.int32()), lists(less(x.cuts + 1, x.doc_bytes), x.doc_cuts, pa.int64()),
                 lists(less(x.group_a, x.doc_a), x.doc_cuts, pa.int32()), lists(less(x.group_b, x.doc_b), x.doc_cuts, pa.int32())], schema=schema)

    return run


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b, ends, a_ends, b_ends): each text's ids, and for each group the byte, and the a and b ids, behind it.

    Bytes are those of the text with a space before it. Texts without tokens (see aligned()) have empty lists.
    """
    bound_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(_grouped(path_a, path_b), _GROUPS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))


def _strings(texts: pa.Array) -> pa.Array:
    return texts if texts.type == pa.string() else texts.cast(pa.string())


_BLOCKS = "block long, doc_ids array<long>, numbers binary, shas array<string>, per_doc binary, pairs binary, codes binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Unsigned integers, their bytes in planes, compressed behind their number."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class _Block:
    """Texts whose links are counted together: their digests, and each text's distinct pairs with their numbers."""

    def __init__(self):
        self.ids, self.numbers, self.shas, self.docs, self.codes, self.counts, self.bytes = [], [], [], [], [], [], 0

    def add(self, ids: list, x: Alignment, strings: Strings, size: int) -> None:
        n = len(x.doc_a) - 1
        self.numbers.append(np.stack([np.diff(d) for d in (x.doc_a, x.doc_b, x.doc_cuts, x.doc_links)]))
        self.shas += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.told(strings)]
        codes, at = np.unique(x.a[x.link_a].astype(np.uint64) << np.uint64(32) | x.b[x.link_b], return_inverse=True)
        pairs, counts = np.unique(np.repeat(np.arange(n), np.diff(x.doc_links)) * max(len(codes), 1) + at, return_counts=True)
        self.docs.append(pairs // max(len(codes), 1) + len(self.ids))
        self.codes.append(codes[pairs % max(len(codes), 1)] if len(codes) else codes)
        self.counts.append(counts)
        self.ids += ids
        self.bytes += size

    def row(self, block: int, schema: pa.Schema) -> pa.RecordBatch:
        docs, counts = np.concatenate(self.docs), np.concatenate(self.counts)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        total = np.bincount(at, counts, len(codes)).astype(np.int64)
        per_doc = np.bincount(docs, minlength=len(self.ids))
        steps = _steps(at.astype(np.int64))
        first = np.cumsum(per_doc) - per_doc
        first = first[per_doc > 0]
        steps[first] = at[first]  # each text's pairs ascend; the first stands whole
        values = [block, self.ids, np.concatenate(self.numbers, axis=1).astype("<i8").tobytes(), self.shas, _packed(per_doc), _packed(steps) + _packed(counts), _packed(_steps(codes)), _packed(total)]
        values[5] = len(_packed(steps)).to_bytes(8, "little") + values[5]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _in_blocks(path_a: str, path_b: str):
    schema = arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = _encoder(ByteEncoder, path_a), _encoder(PieceEncoder, path_b)
        strings, task, made, block = Strings(len(a.bytes), len(b.bytes)), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            texts = _strings(batch.column(1))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [*(np.flatnonzero(np.diff(sizes >> 22)) + 1).tolist(), len(texts)] if len(texts) else []
            for x, y in zip([0, *cuts], cuts):
                size = int(sizes[y - 1]) - (int(sizes[x - 1]) if x else 0)
                if block.ids and block.bytes + size > BLOCK_BYTES:
                    yield block.row(task << 32 | made, schema)
                    made, block = made + 1, _Block()
                block.add(batch.column(0).slice(x, y - x).to_pylist(), Alignment(texts.slice(x, y - x), a, b), strings, size)
        if block.ids:
            yield block.row(task << 32 | made, schema)

    return run


_CODES = "block long, code long, n long"


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's pairs."""
    schema = arrow_schema(_CODES)
    for batch in batches:
        for block, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = np.cumsum(_unpacked(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(_unpacked(counts).astype(np.int64))], schema=schema)


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _rated(_key, blocks, found):
    """A block's texts, with what its pairs count in all texts."""
    (row,) = blocks.to_pylist()
    code = found.column("code").to_numpy()
    order = np.argsort(code)
    count, best = found.column("count").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]
    per_doc, raw = _unpacked(row["per_doc"]).astype(np.int64), row["pairs"]
    cut = 8 + int.from_bytes(raw[:8], "little")
    steps, n = _unpacked(raw[8:cut]).astype(np.int64), _unpacked(raw[cut:]).astype(np.int64)
    ends = np.cumsum(per_doc)
    at = np.cumsum(steps)
    at -= np.repeat(np.append(0, at)[ends - per_doc], per_doc)
    summed = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x))[ends]))
    numbers = np.frombuffer(row["numbers"], "<i8").reshape(4, -1)
    values = [row["doc_ids"], *numbers, summed(n * best[at]), summed(n * count[at]), row["shas"]]
    schema = arrow_schema(_ALIGNED)
    return pa.table([pa.array(v, t) for v, t in zip(values, schema.types)], schema=schema)


def _counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = blocks.select("block", "codes", "counts").mapInArrow(_exploded, _CODES)
    return own, own.groupBy("code").agg(F.sum("n").alias("count"))


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, count) of every pair of ids that links, over all texts: a table from one vocabulary to the other."""
    bound_batches(docs.sparkSession)
    blocks = Scratch(docs.sparkSession, "align").save(_texts(docs).mapInArrow(_in_blocks(path_a, path_b), _BLOCKS), "blocks")
    return _counted(blocks)[1].select(F.shiftrightunsigned("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "count")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Texts are encoded by a byte-level vocabulary (a file of tokenizers) with a space before them, and by one of pieces
    (a file of sentencepiece), which puts the space there itself. Bits mark where tokens end; where both do is a cut, and
    cuts part the tokens into groups. Tokens link whose bytes overlap. Counts of pairs are summed over all texts: blocks
    of texts list their pairs once, so what is shuffled grows with the distinct pairs of a block and not with the links,
    and each block gets its own pairs' counts back. The highest count of each b id is a table no longer than the
    vocabulary; it alone is broadcast.

    A null or empty text, and one whose tokens don't spell it, has no tokens: zeros and an empty hash. Texts are aligned
    whole; a very long one is a block of its own. Repeated rows count as often as they stand there, rows without an id
    and rows that share one like any other. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "align")
    blocks = scratch.save(_texts(docs).mapInArrow(_in_blocks(path_a, path_b), _BLOCKS), "blocks")
    own, counts = _counted(blocks)
    counts = scratch.save(counts.withColumn("b", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")), "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "b").select("code", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    found = own.join(counts, "code").select("block", "code", "count", "best")
    rest = blocks.drop("codes", "counts")
    return rest.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_rated, _ALIGNED)
