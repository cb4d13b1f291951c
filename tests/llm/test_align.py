"""Alignment of two tokenizers against brute force by the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from ledgerloom.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def letter_bytes():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in visible}, 0
    for b in range(256):
        if b not in visible:
            out[chr(256 + n)] = b
            n += 1
    return out


LETTERS = letter_bytes()


def spans(ids, spelt):
    out, at = [], 0
    for k, s in zip(ids, spelt):
        out.append((k, at, at + len(s)))
        at += len(s)
    return out


def plain(rows, libraries):
    a, b = libraries
    tokens = []
    for doc, text in rows:
        whole = " " + (text or "")
        ia, ib = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        sa = [bytes(LETTERS[c] for c in a.id_to_token(k)) for k in ia]
        sb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        good = bool(text) and b"".join(sa) == b"".join(sb) == whole.encode()
        tokens.append((doc, spans(ia, sa), spans(ib, sb)) if good else (doc, [], []))
    counts, links = Counter(), []
    for _, ta, tb in tokens:
        own, j = [], 0
        for k, s, e in ta:
            while j < len(tb) and tb[j][2] <= s:
                j += 1
            m = j
            while m < len(tb) and tb[m][1] < e:
                own.append((k, tb[m][0]))
                m += 1
        links.append(own)
        counts.update(own)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for (doc, ta, tb), own in zip(tokens, links):
        ends = sorted({e for _, _, e in ta} & {e for _, _, e in tb})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(k) for k, s, e in ta if start <= s and e <= end) + "|" + ",".join(str(k) for k, s, e in tb if start <= s and e <= end))
            start = end
        told = ";".join(groups)
        out.append((str(doc), len(ta), len(tb), len(ends), len(own), sum(counts[p] == highest[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out)


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(df):
    return sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in df.collect())


TEXTS = ["Hello world", "", None, " ", "  two  blanks ", "line\nbreaks\n\n and\ttabs\r\n", "<|endoftext|> and <s> </s> <unk> <0x0A>", "▁ raw mark", "naïve Größe 中文字符 한국어 🟢 é", "x\x00y", "…—“q”", "a" * 500, "\n", "don't we'll 12345 3.14", "nbsp\xa0wide　", "é ﬁ Ａ"]


def test_small_rows(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 60)
    rows = [*enumerate(TEXTS), (None, "Hello world"), (3, "Hello world"), (3, "Hello world"), (50, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, a int").repartition(3)
    assert told(align.aligned(docs, A, B)) == plain(rows, libraries)
    assert align.aligned(docs.limit(0), A, B).count() == 0


def test_groups_and_counts(spark, libraries):
    rows = [*enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in align.groups(docs, A, B).collect()}
    want = {r[0]: r for r in plain(rows, libraries)}
    for k, text in rows:
        r = by[k]
        assert (len(r["a"]), len(r["b"]), len(r["ends"])) == want[str(k)][1:4]
        if r["ends"]:
            assert r["ends"][-1] == len(text.encode()) + 1 and r["a_ends"][-1] == len(r["a"]) and r["b_ends"][-1] == len(r["b"])
    pairs = align.link_counts(docs, A, B).collect()
    assert sum(r["count"] for r in pairs) == sum(r[4] for r in want.values())


def test_pieces_are_the_library_s(libraries):
    draw = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "▁", "x\ty", "1", "'", "\x00", "\xa0", "Wort", "🟢", "</s>", "."]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(3000)]
    own = align.PieceEncoder(B)
    assert own.alone
    ids, sizes = own.tokens(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == libraries[1].encode(t), repr(t)
        at += n


def test_query(spark, sf_dir, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op12_alignment(spark, sf_dir)) == plain(rows, libraries)
