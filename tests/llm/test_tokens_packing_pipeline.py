"""Token ids, token files, packing and the pipeline: exact round trips and brute force."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_texts import brute_verdicts

from ledgerloom.llm import jaccard, mixing, packing, quality, tokenbin, tokens, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["Hello there, it's fine.\nNew line", "", None, " ", "a  b\n\n c ", "日本 語。 Ünï <|endoftext|> x", "word " * 5000, "Don'T 12345 ½", "ΑΣ é\xa0x", "  y"]


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


ENCODERS = {path: (tokens.Encoder(path), plain(path)) for path in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0'sStTrReE.,!12½éÉσΣſKİ日́​ "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_as_the_library_gives_them(text):
    for own, whole in ENCODERS.values():
        assert own.encode(text) == whole(text).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\x0b\xa0'saB1½_.éΣ日\x1c\u0307"), max_size=12) | st.sampled_from(["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", ""]), max_size=8))
def test_batches_of_texts(texts):
    """Texts of every kind side by side, those with the strings of added tokens included."""
    for own, whole in ENCODERS.values():
        assert own.known
        got = list(own.encode_all(pa.array(texts, pa.string())))
        assert [n for _, sizes in got for n in sizes.tolist()] == [len(whole(t)) for t in texts]
        assert b"".join(ids.tobytes() for ids, _ in got) == b"".join(whole(t).tobytes() for t in texts)


def test_added_tokens_and_other_files(tmp_path, monkeypatch):
    assert tokens.Encoder(WORD).encode("x <|endoftext|> y") == np.array([343, 49407, 344], "<u4").tobytes()
    assert 50256 in np.frombuffer(tokens.Encoder(BYTE).encode("a <|endoftext|> b"), "<u4")
    other = json.loads(open(BYTE, encoding="utf-8").read())
    other["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(other))
    own = tokens.Encoder(str(tmp_path / "other.json"))
    assert not own.known and own.encode("Some TEXT") == plain(str(tmp_path / "other.json"))("Some TEXT").tobytes() == ENCODERS[BYTE][0].encode("some text")
    monkeypatch.setattr(tokens, "TOGETHER", 16)
    texts = ["one", "two three four five six seven", "", "eight", "nine ten eleven twelve thirteen"] * 3
    got = list(ENCODERS[BYTE][0].encode_all(pa.array(texts)))
    assert len(got) > 3 and b"".join(ids.tobytes() for ids, _ in got) == b"".join(plain(BYTE)(t).tobytes() for t in texts)


def test_kept_units_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    for path in (BYTE, WORD):
        e = tokens.Encoder(path)
        for text in ("a b c d e f g", "a b c d e f g h", "x a"):
            assert e.encode(text) == plain(path)(text).tobytes()


def table(spark, texts):
    return spark.createDataFrame([(t[0], t[1], "en", "s", 0) if isinstance(t, tuple) else (i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def test_token_files(spark):
    docs = table(spark, [*TEXTS, (3, "again"), (3, "again"), (None, "no id"), (-5, "minus")]).withColumn("start", F.lit("a clash")).repartition(3)
    rows = tokenbin.round_trip(docs, BYTE, 2).orderBy("start").collect()
    encode, want, at = plain(BYTE), Counter(), 0
    for r in docs.collect():
        ids = np.append(encode(r["text"]), np.uint32(2)).astype("<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    order = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order)
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert tokenbin.round_trip(docs.limit(0), BYTE, 2).count() == 0


def checked(rows, docs, window=2048):
    """Padding of packed rows, after all their laws were held."""
    encode, want, got = plain(WORD), Counter(), Counter()
    for r in docs.collect():
        want[r["doc_id"], np.append(encode(r["text"]), np.uint32(1)).astype("<u4").tobytes()] += 1
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= window
    assert sorted(places) == list(range(len(places)))
    pieces = defaultdict(lambda: defaultdict(list))
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"]].append(np.array(r["ids"], "<u4").tobytes())
    for (doc, n), at in pieces.items():
        whole = [(d, b, m) for (d, b), m in want.items() if d == doc and len(b) == 4 * n]
        assert sum(len(b) for own in at.values() for b in own) == sum(4 * n * m for _, _, m in whole)
        for start, own in at.items():
            assert all(any(b[4 * start :].startswith(p) for _, b, _ in whole) for p in own)
        got[doc, n] += 1
    assert set(got) == {(d, len(b) // 4) for d, b in want}
    return sum(window - sum(n for _, n in own) for own in places.values())


def test_packing(spark):
    r = random.Random(8)
    docs = table(spark, [*TEXTS, *(" ".join("w%d" % r.randint(0, 99) for _ in range(int(r.lognormvariate(5.2, 1)))) for _ in range(300)), (3, " "), (None, "no id")]).withColumn("length", F.lit("a clash"))
    rows = packing.pack(docs, WORD, 1, with_ids=True).collect()
    assert checked(rows, docs) < 0.01 * sum(r["length"] for r in rows) + 2048
    assert packing.pack(docs.limit(0), WORD, 1).count() == 0
    same = table(spark, ["x " * 1499] * 40)
    assert checked(packing.pack(same, WORD, 1, with_ids=True).collect(), same) < 2048


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {2047: 3, 1: 3}, {1500: 100}, {700: 9, 648: 4, 3: 2}, {k: 2 for k in range(1, 2048, 7)}])
def test_plan_deals_every_remainder(histogram):
    p = packing.plan(histogram)
    for length, n in histogram.items():
        at = 0
        for first, times, sequence, offset in sorted(p.segments.get(length, [])):
            assert first == at and 0 <= sequence and sequence + times <= p.sequences and offset + length <= 2048
            at += times
        assert at == (p.cut[length][0] if length in p.cut else n)


def test_least_squares():
    r = np.random.RandomState(9)
    for _ in range(20):
        a, x = r.randint(0, 3, (12, 20)).astype(float), np.maximum(r.randn(20), 0)
        got = packing.nnls(a, a @ x)
        assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-5
    assert packing.nnls(np.eye(2), np.array([-1.0, 2.0])).tolist() == [0.0, 2.0]
    assert sorted(packing.combinations(4, 3)) == [(2, 1, 1), (2, 2), (3, 1), (4,)]


def brute_groups(rows, n, percent):
    """doc_id -> the least doc_id that links reach, over all pairs of distinct n-word shingles."""
    own = {}
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or "")) if x]
        own[r["doc_id"]] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in own}
    links = [(a, b) for a in own for b in own if a < b and own[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    for _ in own:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_pipeline_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit("clash"), "kept": F.lit(1)})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = Counter(r[0] for r in out.select("doc_id").collect())
        if k == 0:
            want = toxicity.verdicts(docs, labels).where("predicted = 0")
        elif k == 1:
            want = quality.judged(docs.drop("kept")).where("kept")
            kept = brute_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()])
            assert set(ids) == {i for i, stays in kept.items() if stays}
        elif k == 2:
            want = jaccard.linked(docs, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE).where("doc_id = component_id")
            assert sorted(ids.elements()) == sorted(set(brute_groups(docs.collect(), 5, 80).values()))
        else:
            want = mixing.mix(docs).select(F.explode(F.array_repeat("doc_id", F.when(F.col("taken") > F.col("size"), 2).when(F.col("taken") > 0, 1).otherwise(0))).alias("doc_id"))
        assert ids == Counter(r[0] for r in want.select("doc_id").collect()) and ids
        docs = out
    rows = packing.pack(docs, WORD, 1, with_ids=True).collect()
    checked(rows, docs)
    last = corpus_pipeline.packed(spark, docs, sf)
    assert last.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and last.count() == len(rows)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_pipeline_of_a_very_long_text(spark, tmp_path):
    """A document of 100,000 words goes through all stages beside the others, whole, and so do nulls and repeated rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = [r["text"] for r in docs.where("lang = 'en' AND text IS NOT NULL").select("text").collect()]
    long = "\n".join(f"{k} {t}" for k in range(1 + 100_000 // len(" ".join(own).split())) for t in own)
    assert len(long.split()) >= 100_000
    more = [(900_001, long, "en", "src0", len(long)), (900_002, None, None, None, None), (900_003, None, "en", "src1", None)]
    (tmp_path / "in").mkdir()
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "in" / "labels.parquet"))
    made = spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[2:4]:
        made = stage(spark, made, str(tmp_path / "in"))
        assert made.where("doc_id = 900001 AND text IS NOT NULL").count() >= 1
    whole = made.where("doc_id = 900001").orderBy(F.length("text").desc()).first()["text"]
    rows = corpus_pipeline.packed(spark, made.where("doc_id = 900001").orderBy(F.length("text").desc()).limit(1), str(tmp_path / "in")).collect()
    assert sum(r["length"] for r in rows) == len(plain(WORD)(whole)) + 1 and len(rows) >= 40
    assert corpus_pipeline.run(spark, str(tmp_path / "in")).count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_wide_vocabularies(spark, tmp_path):
    """70,000 entries: ids beyond 16 bits come back whole, from files and from packs."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "wide.json")
    own = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)}, unk_token="w0"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(path)
    assert tokens.id_type(path, 2) == "<u4" and tokens.id_type(WORD, 1) == "<u2" and tokens.id_type(WORD, 70_000) == "<u4"
    with pytest.raises(ValueError, match="70000"):
        tokens.ends_after(np.array([70_000], np.uint32), np.array([1]), 2, "<u2")
    docs = spark.createDataFrame([(1, "w69999 w1 w65536"), (2, "w5")], "doc_id long, text string")
    want = {1: [69_999, 1, 65_536, 2], 2: [5, 2]}
    crc = {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in want.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in tokenbin.round_trip(docs, path, 2).collect()} == crc
    assert {r["doc_id"]: r["ids"] for r in packing.pack(docs, path, 2, with_ids=True).collect()} == want
