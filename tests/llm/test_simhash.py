"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import queries, simhash


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain(rows, radius=2):
    """{(doc_id, fingerprint, component)} of (doc_id, text) rows, by comparing all."""
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                if rows[x][0] > rows[y][0]:
                    x, y = y, x
                root[y] = x
    return sorted((str(r[0]), f"{p:016x}", str(None if r[0] is None else rows[find(k)][0])) for k, (r, p) in enumerate(zip(rows, prints)))


def told(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_small_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(5, "One two three four"), (3, "one TWO three\tfour"), (9, None), (8, ""), (7, " \n"), (2, "a"), (4, "a b"), (4, "other words here and there"), (None, "a"), (6, long), (1, long + " w1"), (11, "É é"), (12, "x\x00y z"), (2, "a")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, rep int")
    assert told(simhash.near_duplicates(docs)) == plain(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_close_pairs(radius):
    draw = random.Random(radius)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = np.array([b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(20)], np.uint64)
    lows = np.array([draw.randint(0, len(prints)) for _ in prints])
    highs = np.array([draw.randint(0, len(prints)) for _ in prints])
    found = sorted((int(x), int(y)) for i, j in simhash.close_pairs(prints, lows, highs, radius) for x, y in zip(i, j))
    want = sorted((a, b) for a in range(len(prints)) for b in range(lows[a], highs[a]) if bin(int(prints[a] ^ prints[b])).count("1") <= radius)
    assert found == want


def test_tiles_of_a_crowded_band(spark, monkeypatch):
    """Fingerprints that share a band, in many small tiles: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(7)
    base = [draw.getrandbits(43) << 21 | 5 for _ in range(60)]
    prints = sorted({b ^ sum(1 << draw.randrange(21, 64) for _ in range(draw.randint(0, 3))) for b in base for _ in range(8)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = simhash.Scratch(spark, "test")
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), scratch).collect()
    own = {p: p for p in signed}

    def find(p):
        while own[p] != p:
            p = own[p]
        return p

    for r in links:
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2
        own[find(r["a"])] = find(r["b"])
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                assert find(a) == find(b)
    assert len(links) < 8 * len(prints)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op11_simhash(spark, sf_dir)) == plain(rows)


def test_spark_hash(spark):
    text = "Größe und maß"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)
