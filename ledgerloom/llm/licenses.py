"""License scans by diagonal voting: word k-gram hashes joined to template positions, counted by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ALNUM_WORD, ascii_lower, or_empty

#: The phrases whose places are counted, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Wording of notices and grants of public licenses, with their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]
#: Words so common that a pair of them says nothing: such a pair of a template casts no vote.
COMMON = {"a", "and", "any", "as", "at", "by", "for", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "with", "you"}
#: A span's diagonals lie at most so far apart: so many words may be missing or put in, all told.
GAP = 3
#: A template of fewer than SHORT votes needs all of them, a longer one this part.
SHORT, PART = 8, 0.75
_SENTINEL = -1


def _seeds(phrases, templates) -> tuple[list[tuple], list[tuple]]:
    """(template, place, vote, first word, second word) of all voting pairs; (template, label, votes, needed, is a phrase, the votes' places)."""
    seeds, about = [], []
    for t, (text, label) in enumerate([*phrases, *templates]):
        words, base = text.split(), t < len(phrases)
        own = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if base or not (a in COMMON and b in COMMON)]
        if not 0 < len(own) <= 63:
            raise ValueError(f"a template takes 1 to 63 votes, not {len(own)}: {text!r}")
        seeds += [(t, i, v, a, b) for v, (i, a, b) in enumerate(own)]
        about.append((t, label, len(own), len(own) if base or len(own) < SHORT else int(-(-len(own) * PART // 1)), base, [i for i, _, _ in own]))
    return seeds, about


def _in_order(span, votes, places):
    """How many votes of a span (line, bits) stand in the text in the template's order, at most.

    On one diagonal all do. Else the longest chain of hits that ascend both in the text and in the template counts.
    """
    set_ = lambda l: F.filter(F.sequence(F.lit(0), votes - 1), lambda v: F.getbit(l["bits"], v) == 1)
    hits = F.flatten(F.transform(span, lambda l: F.transform(set_(l), lambda v: F.struct((l["line"] + F.get(places, v)).alias("at"), v.alias("vote")))))
    best = lambda chains: F.coalesce(F.array_max(F.transform(chains, lambda c: c["n"])), F.lit(0))
    behind = lambda chains, h: F.filter(chains, lambda c: (c["at"] < h["at"]) & (c["vote"] < h["vote"]))
    none = F.array().cast("array<struct<at:int,vote:int,n:int>>")
    longest = F.aggregate(F.array_sort(hits), none, lambda chains, h: F.concat(chains, F.array(F.struct(h["at"].alias("at"), h["vote"].alias("vote"), (best(behind(chains, h)) + 1).alias("n")))), best)
    return F.when(F.size(span) == 1, F.bit_count(F.get(span, 0)["bits"])).otherwise(longest)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """License labels of whole texts.

    Every pair of neighbouring words is hashed and joined to the templates' positions, a constant table. A match votes
    for the diagonal on which the template would lie; a bit for each voting pair makes repeated votes count once. The
    words of a match are compared, so a hash only finds them. A phrase is found where all its votes share a diagonal.
    Diagonals no more than GAP apart merge into a span, which so is no longer than its template and GAP words. Spans are
    verified: votes count if they stand in the template's order, and a template is found where enough of them do.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (their least and greatest start, else
    null), base_labels, labels, score (1 with a phrase, else the largest part of a template's votes in one span). A
    null or empty text has no words and empty labels; very long texts are scanned whole, as one row; repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    seeds, about = _seeds(phrases, templates)
    index = spark.createDataFrame(seeds, "t int, place int, vote int, a string, b string").withColumn("h", F.xxhash64("a", "b"))
    marks = spark.createDataFrame([(_SENTINEL, 0, 0, None, None, 0)], "t int, place int, vote int, a string, b string, h long")
    about_t = F.broadcast(spark.createDataFrame(about, "t int, label string, votes int, needed int, base boolean, places array<int>"))

    text = or_empty("text")
    words = F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_text"), words.alias("_words")).withColumn("n_words", F.size("_words").cast("long"))
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("first"), b.alias("second"))
    pairs = F.zip_with(F.col("_words"), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), pair)
    # the first entry stands for the document itself, so that documents without a match stay; the last pair, without a second word, matches nothing
    itself = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second")))
    # words go with their pair: a row that held all words would make the scan of a text grow with the square of its length
    rows = rows.select("doc_id", "_text", "n_words", F.posexplode(F.concat(itself, pairs)).alias("_at", "_pair")).select("doc_id", "_text", "n_words", "_at", "_pair.*")
    hits = rows.join(F.broadcast(index.unionByName(marks)), "h")
    same = (F.col("first") == F.col("a")) & (F.col("second") == F.col("b"))
    hits = hits.where(F.when(F.col("t") == _SENTINEL, F.col("_at") == 0).otherwise((F.col("_at") > 0) & same))
    key = ["doc_id", "_text", "n_words"]
    lines = hits.select(*key, "t", F.when(F.col("t") == _SENTINEL, 0).otherwise(F.col("_at") - 1 - F.col("place")).cast("int").alias("line"), F.expr("shiftleft(1L, vote)").alias("bit"))
    lines = lines.groupBy(*key, "t", "line").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))

    span = F.collect_list(F.struct("line", "bits")).over(W.partitionBy(*key, "t").orderBy("line").rangeBetween(0, GAP))
    spans = lines.withColumn("span", span).join(about_t, "t", "left").withColumn("full", F.col("base") & (F.bit_count("bits") == F.col("votes")))
    spans = spans.withColumn("got", F.when(F.col("base"), F.col("full").cast("int") * F.col("votes")).otherwise(_in_order(F.col("span"), F.col("votes"), F.col("places"))))
    found = F.col("got") >= F.col("needed")
    labels = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))
    first = F.when(F.col("full"), F.col("line")).cast("long")
    out = spans.groupBy(*key).agg(
        F.max(F.when(F.col("t") == _SENTINEL, F.col("n"))).alias("_copies"), F.count_if("full").alias("n_base"), F.min(first).alias("first_word"), F.max(first).alias("last_word"),
        labels(F.col("full")).alias("base_labels"), labels(found).alias("labels"),
        F.coalesce(F.max(F.col("got") / F.col("votes")), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """DuckDB SQL for scan() over the table documents."""
    seeds, about = _seeds(PHRASES, TEMPLATES)
    text = lambda x: "'" + x.replace("'", "''") + "'"
    seed_rows = ", ".join(f"({t}, {place}, {vote}, {text(a)}, {text(b)})" for t, place, vote, a, b in seeds)
    about_rows = ", ".join(f"({t}, {text(label)}, {votes}, {needed}, {str(base).lower()})" for t, label, votes, needed, base, _ in about)
    return f"""
        WITH RECURSIVE seed(t, place, vote, a, b) AS (VALUES {seed_rows}), about(t, label, votes, needed, base) AS (VALUES {about_rows}),
        d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        word AS (SELECT k, unnest(w) AS a, unnest(range(len(w))) AS i FROM d),
        pair AS (SELECT x.k, x.i, x.a, y.a AS b FROM word x JOIN word y ON x.k = y.k AND y.i = x.i + 1),
        hit AS (SELECT k, t, i - place AS line, i, vote, votes, needed, base, label FROM pair JOIN seed USING (a, b) JOIN about USING (t)),
        phrase AS (SELECT k, label, line FROM hit WHERE base GROUP BY k, t, label, line, votes HAVING count(*) = votes),
        start AS (SELECT DISTINCT k, t, line AS d FROM hit WHERE NOT base),
        inside AS (SELECT s.k, s.t, s.d, h.i, h.vote FROM start s JOIN hit h ON s.k = h.k AND s.t = h.t AND h.line BETWEEN s.d AND s.d + {GAP}),
        chain AS (SELECT k, t, d, i, vote, 1 AS n FROM inside
                  UNION SELECT m.k, m.t, m.d, m.i, m.vote, c.n + 1 FROM chain c JOIN inside m ON c.k = m.k AND c.t = m.t AND c.d = m.d AND m.i > c.i AND m.vote > c.vote),
        got AS (SELECT k, label, max(n) AS n, any_value(votes) AS votes, any_value(needed) AS needed FROM chain JOIN about USING (t) GROUP BY k, t, label),
        score AS (SELECT k, max(n / votes) AS score FROM got GROUP BY k),
        named AS (SELECT k, label FROM phrase UNION SELECT k, label FROM got WHERE n >= needed),
        all_named AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY k),
        per AS (SELECT k, count(*) AS n_base, min(line) AS lo, max(line) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrase GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score FROM d LEFT JOIN per USING (k) LEFT JOIN all_named USING (k) LEFT JOIN score USING (k)"""
