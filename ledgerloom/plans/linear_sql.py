"""DuckDB SQL for linear models: the same passes, batches and whole-number sums as operators/linear.py."""

from __future__ import annotations

from ledgerloom.functions import numbers as N
from ledgerloom.operators import linear as LN

_PLACE = "CAST('0x' || substr(md5({}), 1, 4) AS INTEGER)"
_UNIT = "CAST(floor({} + 0.5::DOUBLE) AS BIGINT)"
_LOGIT, _GRADIENT = f"{LN.LOGIT}::DOUBLE", f"{LN.GRADIENT}::DOUBLE"


def features(name: str, key: str, table: str, text: str = "text") -> str:
    """name(key, b, x): the places of a text's first words, and what each of them counts."""
    place = _PLACE.format("t")
    words = f"list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda t: t <> '')[1:{LN.MAX_TOKENS}]"
    return f"""{name} AS MATERIALIZED (SELECT {key}, b, 1::DOUBLE / sqrt(greatest(len(b), 1)::DOUBLE) AS x FROM (SELECT {key}, list_transform({words}, lambda t: {place}) AS b FROM {table}))"""


def logits(rows: str, weights: str, key: str, more: str = "") -> str:
    """(key, more, z): whole units of the logits of rows(key, b, x)."""
    bias = f"(SELECT {_UNIT.format(f'weight * 1::DOUBLE * {_LOGIT}')} FROM {weights} WHERE bucket = {LN.BIAS})"
    word = _UNIT.format(f"weight * x * {_LOGIT}")
    return f"""(SELECT {key}{more}, x, CAST({bias} + coalesce(u, 0) AS BIGINT) AS z FROM {rows} r
        LEFT JOIN (SELECT {key}, sum({word}) AS u FROM (SELECT {key}, x, unnest(b) AS bucket FROM {rows}) JOIN {weights} USING (bucket) GROUP BY {key}) USING ({key}))"""


def trained(table: str = "r") -> str:
    """CTEs that train on table(k, b, x, y, batch): the last is weights(bucket, weight)."""
    steps, now = [f"w0 AS MATERIALIZED (SELECT bucket, 0::DOUBLE AS weight, 0::DOUBLE AS h FROM (SELECT DISTINCT unnest(b) AS bucket FROM {table} UNION SELECT {LN.BIAS}))"], "w0"
    for s in range(LN.EPOCHS * LN.BATCHES):
        own = f"(SELECT * FROM {table} WHERE batch = {s % LN.BATCHES})"
        p = f"1::DOUBLE / (1::DOUBLE + exp(-(z / {_LOGIT})))"
        steps.append(f"p{s} AS MATERIALIZED (SELECT k, x, y, {p} AS p FROM {logits(own, now, 'k', ', y')})")
        steps.append(f"""g{s} AS (SELECT bucket, CAST(sum(q) AS DOUBLE) / {_GRADIENT} / (SELECT count(*) FROM p{s}) AS m FROM (
            SELECT unnest(b) AS bucket, {_UNIT.format(f'(p - r.y) * r.x * {_GRADIENT}')} AS q FROM p{s} JOIN {table} r USING (k)
            UNION ALL SELECT {LN.BIAS}, {_UNIT.format(f'(p - y) * {_GRADIENT}')} FROM p{s}) GROUP BY bucket)""")
        steps.append(f"""w{s + 1} AS MATERIALIZED (SELECT bucket, CASE WHEN m IS NULL THEN weight ELSE weight - {LN.RATE}::DOUBLE * m / (sqrt(h + m * m) + {LN.LEAST:.8f}::DOUBLE) END AS weight,
            CASE WHEN m IS NULL THEN h ELSE h + m * m END AS h FROM {now} LEFT JOIN g{s} USING (bucket))""")
        now = f"w{s + 1}"
    return ", ".join(steps) + f", weights AS (SELECT bucket, weight FROM {now})"


def predicted(rows: str, weights: str, key: str) -> str:
    """(key, logit_0, logit_1, pred_class, pred_label, confidence) of rows(key, b, x)."""
    return f"""SELECT {key}, round(0 - z / 2, 6) + 0 AS logit_0, round(z / 2, 6) + 0 AS logit_1, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred_class,
        CASE WHEN z > 0 THEN '{N.CLASS_TEXTS[1]}' ELSE '{N.CLASS_TEXTS[0]}' END AS pred_label, round(100::DOUBLE / (1 + exp(-abs(z))), 6) AS confidence
        FROM (SELECT {key}, z / {_LOGIT} AS z FROM {logits(rows, weights, key)})"""
