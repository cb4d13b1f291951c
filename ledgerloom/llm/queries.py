"""The corpus operators as queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, divergence, jaccard, licenses, mixing, packing, ppm, quality, sharding, simhash, tokenbin, topk, toxicity
from .common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).drop("text_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_mixing, op3_licenses, op4_ppm, op5_jaccard, op6_toxicity, op7_sharding, op8_quality, op9_packing, op10_tokens, op11_simhash, op12_alignment, op13_divergence)}

ORACLE = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT lang, source, k, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        c AS (SELECT o.lang, o.source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // CAST(g.total + v.v AS HUGEINT) AS HUGEINT) AS p,
                     CAST(1 + 1000000000 * (kept.n + 1) // CAST(v.n + v.v AS HUGEINT) AS HUGEINT) AS q
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM k WHERE part = 'pair' OR rank <= 200""",
    "op3_licenses": licenses.oracle(),
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS o FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS w, CAST([1.5, 1.0, 0.5][(k - 1) % 3 + 1] AS DOUBLE) AS a,
                     CAST([0.5, 1.0, 1.5][(k - 1) % 3 + 1] AS DOUBLE) AS b, source_size * CAST(2 AS DOUBLE) AS most FROM s),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
                         - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
        f AS (SELECT *, max(lev) FILTER (WHERE lev * w < most) OVER () AS fin FROM l),
        t AS (SELECT source, source_size, a, b, CASE WHEN lev * w < most THEN fin * w ELSE most END AS target FROM f),
        r AS (SELECT doc_id, size, source_size, target, a, b, floor(target + 0.5) AS goal,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c1
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, CAST(greatest(0, least(c1 + size, goal) - c1) AS BIGINT) AS p1,
                     CAST(greatest(0, least(c1 + source_size + size, goal) - (c1 + source_size)) AS BIGINT) AS p2, c1 + source_size AS c2 FROM r)
        SELECT doc_id, size, source_size, target, p1 + p2 AS taken,
               CASE WHEN p1 > 0 THEN least(greatest(CASE WHEN a = b THEN c1 / target ELSE (sqrt(greatest(a * a + 2.0::DOUBLE * (b - a) * (c1 / target), 0)) - a) / nullif(b - a, 0) END, 0), 1) + 0.0::DOUBLE END AS position,
               CASE WHEN p2 > 0 THEN least(greatest(CASE WHEN a = b THEN c2 / target ELSE (sqrt(greatest(a * a + 2.0::DOUBLE * (b - a) * (c2 / target), 0)) - a) / nullif(b - a, 0) END, 0), 1) + 0.0::DOUBLE END AS again
        FROM p""",
}
