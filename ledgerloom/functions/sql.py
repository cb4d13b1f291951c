"""The report expressions as functions of a session, written in SQL: queries that use them stay in the JVM.

    register(spark)
    register_prices(spark, prices)
    SELECT report_id, clean_report(raw_text), m.* FROM texts, LATERAL report_metadata(raw_text) m
    SELECT r.*, first_price(p.prices, r.day, date_add(r.day, 50)) AS base FROM reports r JOIN price_blocks(50) p ON p.ticker = r.ticker AND p.block = price_block(r.day)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X
from ledgerloom.operators.asof import BLOCK

#: The view of prices that price_blocks() reads: (ticker, trade_date, close).
PRICES = "ledgerloom_prices"


def literal(s: str) -> str:
    """A string as SQL; patterns keep their backslashes."""
    if "'" not in s:
        return f"r'{s}'" if "\\" in s else f"'{s}'"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {literal(pattern)}, {literal(to)})"


def chain(c: str, rules) -> str:
    """SQL that applies cleaning rules in order, then strips."""
    for _, pattern, to in rules:
        c = replaced(c, pattern, to)
    return stripped(c)


def stripped(c: str) -> str:
    return replaced(c, rf"(?U)^{X.SPACE}+|{X.SPACE}+\z")


def let(value: str, name: str, use: str) -> str:
    """use, in which name stands for the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def first(c: str, pattern: str, k: int = 0) -> str:
    return f"nullif(regexp_extract({c}, {literal(pattern)}, {k}), '')"


def texts_of(label: str, texts: dict[int, str]) -> str:
    return f"CASE {label} " + " ".join(f"WHEN {k} THEN {literal(t)}" for k, t in texts.items()) + " END"


def block_of(day: str) -> str:
    return f"floor(unix_date({day}) / {BLOCK})"


def _numeric(c: str) -> str:
    part = lambda k: f"get(split(m, {literal(rf'(?U)[.\-/]{X.SPACE}*')}), {k})"
    year = f"CASE WHEN length({part(0)}) = 2 THEN concat('20', {part(0)}) ELSE {part(0)} END"
    return let(first(c, X.NUMERIC_DATE), "m", f"CASE WHEN m IS NOT NULL THEN concat_ws('.', {year}, {part(1)}, {part(2)}) END")


def _english(c: str) -> str:
    month = "CASE initcap(substring(m, 1, 3)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MONTHS.items()) + " END"
    day = f"lpad(regexp_extract(m, {literal(r'(?U)(\d{1,2}),')}, 1), 2, '0')"
    return let(first(c, X.ENGLISH_DATE), "m", f"CASE WHEN m IS NOT NULL THEN concat_ws('.', right(m, 4), {month}, {day}) END")


PRICE = "STRUCT<trade_date: DATE, close: DOUBLE>"
PRICE_LIST = f"ARRAY<{PRICE}>"
#: name, arguments, result type, SQL: the functions of text, numbers and dates.
SCALAR = [
    ("squeeze_digits", "t STRING", "STRING", replaced("t", rf"(?U)(?<=\d){X.SPACE}+(?=\d)")),
    ("security_code", "t STRING", "STRING", first("t", X.CODE, 1)),
    ("numeric_date", "t STRING", "STRING", _numeric("t")),
    ("english_date", "t STRING", "STRING", _english("t")),
    ("report_date_text", "t STRING", "STRING", "coalesce(english_date(t), numeric_date(t))"),
    ("to_report_date", "s STRING", "DATE", "try_to_date(s, 'yyyy.MM.dd')"),
    ("clean_report", "t STRING", "STRING", chain("t", X.FULL)),
    ("clean_prototype_basic", "t STRING", "STRING", chain("t", X.PROTOTYPE_BASIC)),
    ("clean_prototype_full", "t STRING", "STRING", chain("t", X.PROTOTYPE_FULL)),
    ("is_blank_text", "t STRING", "BOOLEAN", f"{stripped("coalesce(t, '')")} = ''"),
    ("file_title", "t STRING", "STRING", f"translate({stripped('t')}, {literal(X.NOT_IN_NAMES)}, '')"),
    ("return_pct", "base DOUBLE, future DOUBLE", "DOUBLE", "try_divide(future - base, base) * 100"),
    ("label_of", "pct DOUBLE", "INT", f"CASE WHEN pct <= {N.THRESHOLD}D THEN 1 ELSE 0 END"),
    ("class_text", "label INT", "STRING", texts_of("label", N.CLASS_TEXTS)),
    ("shown_pct", "pct DOUBLE", "DOUBLE", "bround(pct, 2)"),
    ("price_block", "day DATE", "BIGINT", block_of("day")),
    ("first_price", f"prices {PRICE_LIST}, since DATE, until DATE", PRICE, "array_min(filter(prices, p -> p.trade_date >= since AND p.trade_date <= until))"),
]
#: As SCALAR, with a table as the result.
TABLES = [
    ("report_metadata", "raw STRING", "ticker STRING, report_date_str STRING", "SELECT security_code(t), report_date_text(t) FROM (SELECT squeeze_digits(raw) AS t)"),
]
#: All prices by blocks of days, each with reach days after it, as operators/asof.price_blocks() has them; rows are dealt to {tasks} tasks once.
PRICE_BLOCKS = f"""
    WITH dealt AS (SELECT /*+ REPARTITION({{tasks}}, ticker, block) */ ticker, explode(sequence({block_of("date_add(trade_date, -reach)")}, {block_of("trade_date")})) AS block, trade_date, close FROM {PRICES}),
    one AS (SELECT ticker, block, trade_date, min(close) AS close FROM dealt GROUP BY ticker, block, trade_date)
    SELECT ticker, block, collect_list(struct(trade_date, close)) FROM one GROUP BY ticker, block"""


def register(spark: SparkSession) -> None:
    """Makes the functions of SCALAR and TABLES known to the session, for as long as it lasts."""
    for name, args, kind, body in SCALAR:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, args, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")


def register_prices(spark: SparkSession, prices: DataFrame) -> None:
    """Makes price_blocks(reach) known: (ticker, block, prices) of these prices; needs what register() makes known."""
    prices.select("ticker", "trade_date", "close").createOrReplaceTempView(PRICES)
    body = PRICE_BLOCKS.format(tasks=spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION price_blocks(reach INT) RETURNS TABLE (ticker STRING, block BIGINT, prices {PRICE_LIST}) RETURN {body}")
