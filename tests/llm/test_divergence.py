"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, queries

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, top=200):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    langs = defaultdict(lambda: defaultdict(Counter))
    docs = defaultdict(Counter)
    for text, lang, source in rows:
        found = PATTERN.findall(lower(text or ""))
        langs[lang or ""][source or ""].update(found)
        docs[lang or ""].update(set(found))
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    out = []
    for lang, groups in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        v = len(kept)
        every = Counter()
        for g in groups.values():
            every.update({t: g[t] for t in kept})
        sums = {s: sum(g[t] for t in kept) for s, g in groups.items()}
        p = {s: [share(g[t], sums[s], v) for t in kept] for s, g in groups.items()}
        q = [share(every[t], sum(every[t] for t in kept), v) for t in kept]
        f = lambda x, y: (x - y) * (x - y) // y
        for s, g in groups.items():
            pairs = sorted(((sum(map(f, p[s], p[o])), o) for o in groups if o != s), key=lambda r: (-r[0], r[1].encode()))
            terms = sorted(((f(x, y), t) for x, y, t in zip(p[s], q, kept) if g[t] and x > y), key=lambda r: (-r[0], r[1].encode()))[:top]
            out += [(lang, s, "pair", o, x, k) for k, (x, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, x, k) for k, (x, t) in enumerate(terms, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, block int").repartition(3)


def test_small_rows(spark, monkeypatch):
    """Several slices and blocks, nulls, groups without terms, ties, a long text, repeated rows."""
    monkeypatch.setattr(divergence, "SLICE", 7)
    monkeypatch.setattr(divergence, "SLICE_NUMBERS", 40)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 20)
    draw = random.Random(1)
    words = [f"{a}{b}" for a in "abcdef" for b in ("x", "Y", "é", "中z")] + ["it's", "a1b", "--", "x\x00y"]
    rows = [(" ".join(draw.choices(words, k=draw.randint(1, 30))), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "s4", "s5", "", None, "é"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("12 34", "xx", "lone"), ("once", "yy", "a"), ("", "yy", "b"), (" ".join(words * 4000), "en", "s1")] + [("ax Ax aX", "en", "s2")] * 3
    assert told(divergence.audit(made(spark, rows))) == plain(rows)
    assert divergence.audit(made(spark, rows).limit(0)).count() == 0


def test_many_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TOP", 5)
    names = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(400)]
    rows = [(" ".join(names[k % 7 :: 1 + k % 3]), "en", f"s{k % 4}") for k in range(24)]
    assert told(divergence.audit(made(spark, rows))) == plain(rows, 5)


@pytest.mark.parametrize("blocks", range(1, 12))
def test_rounds(spark, blocks):
    """Each two blocks meet once, and no block twice in a round."""
    df = spark.range(blocks).select(F.col("id").cast("int").alias("b")).select("b", F.explode(divergence.rounds(F.col("b"), F.lit(blocks))).alias("m"))
    met = [(r["b"], r["m"]["seat"], r["m"]["round"]) for r in df.collect()]
    assert sorted(tuple(sorted(m[:2])) for m in met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]
    busy = [(x, r) for a, b, r in met for x in (a, b)]
    assert len(busy) == len(set(busy))


def test_shares_are_exact():
    draw = random.Random(2)
    for _ in range(300):
        total, terms = draw.randrange(10 ** draw.randint(1, 15)), draw.randrange(1, 10 ** draw.randint(1, 8))
        c = np.array([draw.randint(0, total) for _ in range(5)] + [0, total], np.int64)
        assert divergence.shares(c, total, terms).tolist() == [1 + 10**9 * (int(x) + 1) // (total + terms) for x in c]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    got = told(queries.op13_divergence(spark, sf_dir))
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLE['op13_divergence']})").fetchall()) == got
