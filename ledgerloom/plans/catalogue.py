"""Every operator as a query over the driver's tables, beside DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import html as H
from ledgerloom.functions import numbers as N
from ledgerloom.functions import sql as Q
from ledgerloom.functions import text as X
from ledgerloom.operators import asof, labeling, linear
from ledgerloom.operators import reports as R
from ledgerloom.plans import linear_sql as LSQL
from ledgerloom.plans import training
from ledgerloom.sources import fixtures as S
from ledgerloom.sources import listings as L

HOST, LISTING, FOLDER, AHEAD = "https://reports.example", "https://reports.example/list", "./pdf_data", 300
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- shared SQL -----------------------------------------------------------------------------------------------------
PRICES = """prices AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice / l_quantity) AS close
            FROM lineitem GROUP BY 1, 2)"""
REPORTS = "reports AS (SELECT o_orderkey AS report_id, lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS ticker, CAST(o_orderdate AS DATE) AS rd FROM orders)"


def priced(reports: str = "reports") -> str:
    return f"""priced AS (SELECT r.report_id, min(p.d) AS base_date, arg_min(p.close, p.d) AS base_close, min(p.d) FILTER (WHERE p.d >= r.rd + 30) AS future_date,
               arg_min(p.close, p.d) FILTER (WHERE p.d >= r.rd + 30) AS future_close
        FROM {reports} r LEFT JOIN prices p ON p.ticker = r.ticker AND p.d >= r.rd AND p.d <= r.rd + 50 GROUP BY r.report_id),
        rated AS (SELECT *, CASE WHEN base_close <> 0 THEN (future_close - base_close) / base_close * 100 END AS pct,
               CASE WHEN base_close IS NULL THEN 'no price' WHEN future_close IS NULL THEN 'no later price' ELSE 'ok' END AS status FROM priced)"""


TEXTS = """texts AS (SELECT o_orderkey AS report_id, '기업분석 (' || CASE WHEN o_orderkey % 11 = 0 THEN '없음' ELSE 'A' || lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') END || ')' || chr(10)
    || CASE o_orderkey % 3 WHEN 0 THEN strftime(d, '%Y.%m.%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%b %d, %Y') END
    || chr(10) || '문의 analyst' || CAST(o_orderkey % 7 AS VARCHAR) || '@broker.example 전화 02-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey * 7 % 10000 AS VARCHAR), 4, '0')
    || '. ' || chr(10) || 'B u y the dip 목표주가 ' || CAST(o_orderkey % 900 + 100 AS VARCHAR) || ',500원 현재주가 9800원 상승여력 12.5% KOSPI 2,650.10pt 시가총액 3조 2천만원 발행주식수 1200만주 '
    || '액면가 500원 자본금 45억원 매수 (유지) Stock Data  실적은' || chr(10) || '견조하다.' || chr(10) || '2024.05.29 종목 123456 전망  밝다.' || chr(10) || '60일 평균거래 12만주 끝' AS raw_text
    FROM (SELECT *, CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR AS d FROM orders))"""


def squeezed(c: str) -> str:
    once = r"regexp_replace({}, '(\d)\s+(\d)', '\1\2', 'g')"
    return once.format(once.format(c))


def code_sql(c: str) -> str:
    return f"nullif(regexp_extract({c}, '(^|[^0-9])([0-9]{{6}})([^0-9]|$)', 2), '')"


# Date forms and cleaning patterns, in DuckDB's dialect.
NUMERIC = r"(202[0-6]|2[0-6])[.\-/]\s*(0[1-9]|1[0-2])[.\-/]\s*(0[1-9]|[12]\d|3[01])"
ENGLISH = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2}),\s*(202[0-6])"


def numeric_sql(c: str) -> str:
    g = lambda k: f"regexp_extract({c}, '{NUMERIC}', {k})"
    return f"CASE WHEN {g(1)} <> '' THEN CASE WHEN length({g(1)}) = 2 THEN '20' ELSE '' END || {g(1)} || '.' || {g(2)} || '.' || {g(3)} END"


def english_sql(c: str) -> str:
    g = lambda k: f"regexp_extract({c}, '{ENGLISH}', {k})"
    months = "CASE lower({}) ".format(g(1)) + " ".join(f"WHEN '{m.lower()}' THEN '{n}'" for m, n in X.MONTHS.items()) + " END"
    return f"CASE WHEN {g(1)} <> '' THEN {g(3)} || '.' || {months} || '.' || lpad({g(2)}, 2, '0') END"


def date_sql(c: str) -> str:
    return f"coalesce({english_sql(c)}, {numeric_sql(c)})"


# what cleaning does, in DuckDB's pattern language, which has no lookaround and dots that stop at line feeds only
EDGE = r"[^\p{L}\p{N}_]"


def _each(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


# Fixed values, as above.
STEPS = {
    "CLN1": lambda c: f"replace(replace(replace({c}, '.' || chr(10), chr(1)), chr(10), ' '), chr(1), '.' || chr(10))",
    "CLN2": lambda c: _each(c, r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+"),
    "CLN3": lambda c: _each(c, r"[A-Za-z]\s[A-Za-z]\s[A-Za-z][^\n]*?([가-힣])", r"\1"),
    "CLN4": lambda c: _each(c, r"\d{2,3}-\d{3,4}-\d{4}"),
    "CLN5": lambda c: _each(c, r"\d{4}\.\d{2}\.\d{2}"),
    "CLN6": lambda c: _each(_each(c, rf"(^|{EDGE})[0-9]{{6}}($|{EDGE})", r"\1\2"), rf"(^|{EDGE})[0-9]{{6}}($|{EDGE})", r"\1\2"),
    "CLN7a": lambda c: _each(c, r"목표주가[^\n]*?\d+원"),
    "CLN7b": lambda c: _each(c, r"현재주가[^\n]*?\d+원"),
    "CLN7c": lambda c: _each(c, r"상승여력[^\n]*?%"),
    "CLN7d": lambda c: _each(c, r"KOSPI[^\n]*?[pP][tT]"),
    "CLN7e": lambda c: _each(c, r"시가총액[^\n]*?[억백십만]+원"),
    "CLN7f": lambda c: _each(c, r"발행주식수[^\n]*?[주]"),
    "CLN7g": lambda c: _each(c, r"액면가[^\n]*?원"),
    "CLN7h": lambda c: _each(c, r"자본금[^\n]*?원"),
    "CLN7i": lambda c: _each(c, r"60일 평균거래[^\n]*"),
    "CLN7j": lambda c: _each(c, r"매수\s*\([가-힣]+\)"),
    "CLN7k": lambda c: _each(c, r"Stock Data"),
    "LINES": lambda c: f"replace({c}, chr(10), ' ')",
    "CLN8": lambda c: _each(c, r"\s+", " "),
}


def chain_sql(c: str, rules) -> str:
    for step, _, _ in rules:
        c = STEPS[step](c)
    return f"trim({c})"


# ---- labels from prices ---------------------------------------------------------------------------------------------
@query(f"""WITH {PRICES}, {REPORTS}, {priced()}
    SELECT report_id, base_date, base_close, future_date, future_close, round_even(pct, 2) AS return_pct, CASE WHEN pct <= -5.0 THEN 1 ELSE 0 END AS label_id FROM rated WHERE status = 'ok'""")
def label_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labeling.label_reports(S.reports(spark, sf_dir), S.prices(spark, sf_dir))
    return out.select("report_id", "base_date", "base_close", "future_date", "future_close", "return_pct", "label_id")


@query(f"""WITH {PRICES}, {REPORTS}, {priced()}
    SELECT report_id, CASE WHEN status = 'ok' THEN strftime(base_date, '%Y-%m-%d') END AS base_date, CASE WHEN status = 'ok' THEN base_close END AS base_close,
           CASE WHEN status = 'ok' THEN strftime(future_date, '%Y-%m-%d') END AS future_date, CASE WHEN status = 'ok' THEN future_close END AS future_close,
           CASE WHEN status = 'ok' THEN round_even(pct, 2) END AS return_pct, CASE WHEN status <> 'ok' THEN NULL WHEN pct <= -5.0 THEN '{N.PROTOTYPE_TEXTS[1]}' ELSE '{N.PROTOTYPE_TEXTS[0]}' END AS label_text,
           CASE status WHEN 'ok' THEN 'ok' WHEN 'no price' THEN '{labeling.NO_PRICES}' ELSE '{labeling.NO_LATER_PRICE}' END AS status FROM rated""")
def label_reports_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_table(S.reports(spark, sf_dir), S.prices(spark, sf_dir))


@query(f"WITH {PRICES}, {REPORTS}, {priced()} SELECT status, count(*) AS n FROM rated GROUP BY status")
def label_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.status_counts(S.reports(spark, sf_dir), S.prices(spark, sf_dir))


def _asof_sql(shift: int, tolerance: int, out: str) -> str:
    return f"""WITH {PRICES}, {REPORTS}, late AS (SELECT report_id, ticker, rd + {shift} AS t FROM reports)
        SELECT report_id, CASE WHEN d <= t + {tolerance} THEN d END AS {out}_date, CASE WHEN d <= t + {tolerance} THEN close END AS {out}_close
        FROM late r ASOF LEFT JOIN prices p ON r.ticker = p.ticker AND r.t <= p.d"""


@query(_asof_sql(0, 50, "base"))
def base_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.forward_asof(S.reports(spark, sf_dir), S.prices(spark, sf_dir), "report_date", "base", 50).select("report_id", "base_date", "base_close")


@query(_asof_sql(30, 20, "future"))
def future_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.reports(spark, sf_dir).withColumn("target", F.date_add("report_date", 30))
    return asof.forward_asof(rows, S.prices(spark, sf_dir), "target", "future", 20).select("report_id", "future_date", "future_close")


@query(f"WITH {PRICES} SELECT ticker, d AS trade_date, close FROM prices WHERE d >= DATE '1993-01-01' AND d <= DATE '1997-12-31'")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prices(spark, S.price_table(spark, sf_dir), start="1993-01-01", end="1997-12-31")


# ---- metadata -------------------------------------------------------------------------------------------------------
@query(f"WITH {TEXTS} SELECT report_id, {squeezed('raw_text')} AS squeezed FROM texts")
def squeeze_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_texts(spark, sf_dir).select("report_id", X.squeeze_digits(F.col("raw_text")).alias("squeezed"))


@query(f"WITH {TEXTS} SELECT report_id, {code_sql(squeezed('raw_text'))} AS ticker FROM texts")
def extract_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_texts(spark, sf_dir).select("report_id", X.security_code(X.squeeze_digits(F.col("raw_text"))).alias("ticker"))


def _dates(name: str, make, sql) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.report_texts(spark, sf_dir).select("report_id", make(X.squeeze_digits(F.col("raw_text"))).alias("report_date_str"))

    f.__name__ = name
    query(f"WITH {TEXTS}, s AS (SELECT report_id, {squeezed('raw_text')} AS t FROM texts) SELECT report_id, {sql('t')} AS report_date_str FROM s")(f)


_dates("extract_date_numeric", X.numeric_date, numeric_sql)
_dates("extract_date_english", X.english_date, english_sql)
_dates("extract_date_priority", X.report_date, date_sql)


@query("""SELECT o_orderkey AS report_id, CAST(try_strptime(strftime(o_orderdate, '%Y.%m.') || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0'), '%Y.%m.%d') AS DATE) AS report_date FROM orders""")
def parse_date_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat(F.date_format("o_orderdate", "yyyy.MM."), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    return S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), N.to_report_date(day).alias("report_date"))


@query(f"WITH {TEXTS}, s AS (SELECT report_id, {squeezed('raw_text')} AS t FROM texts), m AS (SELECT report_id, {code_sql('t')} AS ticker, {date_sql('t')} AS report_date_str FROM s) SELECT * FROM m WHERE ticker IS NOT NULL AND report_date_str IS NOT NULL")
def drop_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.found_metadata(S.report_texts(spark, sf_dir)).drop("raw_text")


# ---- cleaning -------------------------------------------------------------------------------------------------------
def _documents_step(name: str, rules) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.read(spark, sf_dir, "documents").select("doc_id", X.apply_rules(F.col("text"), rules).alias("clean"))

    f.__name__ = name
    c = "text"
    for step, _, _ in rules:
        c = STEPS[step](c)
    query(f"SELECT doc_id, {c} AS clean FROM documents")(f)


def _reports_step(name: str, rules) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.report_texts(spark, sf_dir).select("report_id", X.apply_rules(F.col("raw_text"), rules).alias("clean"))

    f.__name__ = name
    c = "raw_text"
    for step, _, _ in rules:
        c = STEPS[step](c)
    query(f"WITH {TEXTS} SELECT report_id, {c} AS clean FROM texts")(f)


_documents_step("clean_join_lines", [X.JOIN_LINES])
_documents_step("clean_email", [X.EMAIL])
_documents_step("clean_whitespace", [X.COLLAPSE])
_reports_step("clean_spaced_english", [X.SPACED_ENGLISH])
_reports_step("clean_phone", [X.PHONE])
_reports_step("clean_date", [X.DOTTED_DATE])
_reports_step("clean_six_digit", [X.SIX_DIGITS])
_reports_step("clean_noise", X.FIGURES)


#: For each figure's step: a phrase that it takes out, one that it just misses, one that a line feed parts.
VARIED = [
    ("목표주가 12,500원", "목표주가 원", "목표주가\n900원"), ("현재주가(7/1) 98원", "현재주가 98", "현재주가 \n98원"), ("상승여력 약 12.5%", "상승여력 12", "상승\n여력 3%"),
    ("KOSPI 2,650.10pT", "Kospi 2,650pt", "KOSPI\n2,650pt"), ("시가총액 3조 2천만원", "시가총액 3조원", "시가총액\n2백원"), ("발행주식수 1,200만주", "발행주식 12주", "발행주식수\n3주"),
    ("액면가 500원", "액면 500원", "액면가\n500원"), ("자본금 4억원", "자본금 4억", "자본금\n4억원"), ("60일 평균거래량 3주 끝", "60일평균거래 3", "60일\n평균거래 3"),
    ("매수 (유지)", "매수 (hold)", "매수\n(상향)"), ("Stock Data", "Stock  Data", "Stock\nData"),
]


def _varied_sql(rules) -> str:
    """Texts with one phrase each out of VARIED, and what the phrase's own step makes of them."""
    text = lambda p: " || chr(10) || ".join("'" + part + "'" for part in p.split("\n"))
    phrase = " ".join(f"WHEN {3 * k + j} THEN {text(p)}" for k, kinds in enumerate(VARIED) for j, p in enumerate(kinds))
    clean = " ".join(f"WHEN {k} THEN {STEPS[step]('t')}" for k, (step, _, _) in enumerate(rules))
    return f"""WITH v AS (SELECT doc_id, (doc_id % {3 * len(VARIED)}) // 3 AS k, substr(coalesce(text, ''), 1, 200) || ' ' || CASE doc_id % {3 * len(VARIED)} {phrase} END || ' 뒤 x' || chr(10) || substr(coalesce(text, ''), 201, 100) AS t FROM documents)
        SELECT doc_id, CASE k {clean} END AS clean FROM v"""


@query(_varied_sql(X.FIGURES))
def clean_each_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each figure's step alone, on the documents' own text with a phrase that it takes out, just misses, or finds parted."""
    kind = (F.col("doc_id") % (3 * len(VARIED))).cast("int")
    phrase = F.element_at(F.array(*[F.lit(p) for kinds in VARIED for p in kinds]), kind + 1)
    text = F.coalesce("text", F.lit(""))
    t = F.concat(F.substring(text, 1, 200), F.lit(" "), phrase, F.lit(" 뒤 x\n"), F.substring(text, 201, 100))
    rows = S.read(spark, sf_dir, "documents").select("doc_id", F.floor(kind / 3).cast("int").alias("k"), t.alias("t"))
    clean = F.when(F.col("k") == 0, X.apply_rules(F.col("t"), X.FIGURES[:1]))
    for k in range(1, len(X.FIGURES)):
        clean = clean.when(F.col("k") == k, X.apply_rules(F.col("t"), X.FIGURES[k : k + 1]))
    return rows.select("doc_id", clean.alias("clean"))


def _chain(name: str, make, rules) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.report_texts(spark, sf_dir).select("report_id", make(F.col("raw_text")).alias("clean"))

    f.__name__ = name
    query(f"WITH {TEXTS} SELECT report_id, {chain_sql('raw_text', rules)} AS clean FROM texts")(f)


_chain("clean_full", X.clean_report, X.FULL)
_chain("clean_nb_basic", X.clean_prototype_basic, X.PROTOTYPE_BASIC)
_chain("clean_nb_full", X.clean_prototype_full, X.PROTOTYPE_FULL)


# ---- pages, listings, files -----------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 5 = 3 THEN NULL WHEN turn % 7 = 4 THEN '' ELSE text END AS t FROM conversations)
    SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE t IS NOT NULL AND t <> ''), '') AS raw_text FROM p GROUP BY doc_id""")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assemble_pages(S.report_pages(spark, sf_dir), "doc_id", "page_no", "page_text")


@query("SELECT doc_id, substr(text, 1, 1000) AS preview, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def doc_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"SELECT page_id AS page, '{LISTING}?&page=' || CAST(page_id AS VARCHAR) AS url FROM pages")
def listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of all pages of a listing whose numbers a table has."""
    return S.read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), X.listing_url(LISTING, F.col("page_id")).alias("url"))


@query(f"SELECT page_id, CASE WHEN starts_with(h, 'http') THEN h ELSE '{HOST}' || h END AS download_url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/p/' || CAST(page_id AS VARCHAR) END AS h FROM pages)")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/p/"), F.col("page_id").cast("string")))
    return S.read(spark, sf_dir, "pages").select("page_id", X.resolve_link(href, HOST).alias("download_url"))


@query("""SELECT page_id, CAST(i - 1 AS BIGINT) AS at, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>', 1) AS l FROM pages))""")
def extract_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "pages").select("page_id", F.posexplode(H.hrefs(F.col("html"))).alias("at", "href")).select("page_id", F.col("at").cast("bigint").alias("at"), "href")


#: Listing tables of five kinds, after each page's own markup: two rows; a row with markup in its title, in a table of more classes; one without a file; a table of another class; a first row that isn't closed.
_ROW = ('<tr><td>x</td><td><a href="/v"> ', '</a></td><td class="file new"><a href="', '">pdf</a><a href="/no">x</a></td></tr>')
_CLASSES = ["type_1", "a type_1", "type_1", "type_10", "type_1"]
_TITLE = "translate(trim(url), '\\/:*?\"<>|', '')"


@query(f"""WITH r AS (SELECT page_id AS page, 0 AS row_idx, CASE page_id % 5 WHEN 1 THEN 'No. ' ELSE '' END || {_TITLE} AS title, '/d/' || CAST(page_id AS VARCHAR) AS href FROM pages WHERE page_id % 5 IN (0, 1, 4)
    UNION ALL SELECT page_id, 1, 'second ' || CAST(page_id AS VARCHAR), 'https://other.example/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 5 IN (0, 4))
    SELECT page, row_idx, title, href, CASE WHEN starts_with(href, 'http') THEN href ELSE '{HOST}' || href END AS download_url, '{FOLDER}/' || title || '.pdf' AS path FROM r""")
def html_css_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("page_id") % 5, F.col("page_id").cast("string")
    row = lambda title, href: F.concat(F.lit(_ROW[0]), title, F.lit(_ROW[1]), href, F.lit(_ROW[2]))
    first = row(F.concat(F.when(kind == 1, "No.\t<b>").otherwise(""), F.when(kind == 1, F.trim("url")).otherwise(F.col("url")), F.when(kind == 1, "</b>").otherwise("")), F.concat(F.lit("/d/"), number))
    first = F.when(kind == 1, F.regexp_replace(first, "\t", " ")).when(kind == 4, F.regexp_replace(first, "</td></tr>$", "")).when(kind == 2, F.regexp_replace(first, "file new", "none")).otherwise(first)
    second = F.when(kind.isin(0, 4), row(F.concat(F.lit("second "), number), F.concat(F.lit("https://other.example/"), number))).otherwise("")
    table = F.concat(F.lit('<table class="'), F.element_at(F.array(*map(F.lit, _CLASSES)), kind.cast("int") + 1), F.lit('"><tr><th>h</th></tr>'), first, second, F.lit("</table>"))
    return L.report_links(S.read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.concat("html", table).alias("html")), HOST, FOLDER)


@query(f"SELECT p_partkey, title, '{FOLDER}/' || title || '.pdf' AS path FROM (SELECT p_partkey, translate(trim('  ' || p_name || ': \"' || p_type || '\" <' || p_brand || '>*?|/ '), '\\/:*?\"<>|', '') AS title FROM part)")
def sanitize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit(': "'), "p_type", F.lit('" <'), "p_brand", F.lit(">*?|/ "))
    title = X.file_title(raw)
    return S.read(spark, sf_dir, "part").select("p_partkey", title.alias("title"), X.file_path(FOLDER, title).alias("path"))


@query("""SELECT p_brand AS title, p_partkey, n_written FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n_written, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 97 DESC, p_partkey DESC) AS k FROM part) WHERE k = 1""")
def dedup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for reports: of a title the last page's last row, whatever its key."""
    rows = S.read(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.col("p_size").alias("page"), (F.col("p_partkey") % 97).alias("row_idx"), F.col("p_partkey").alias("k"), "p_partkey")
    return R.dedup_titles(rows, "title", ["page", "row_idx", "k"], "p_partkey")


@query("SELECT page_id, name FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS name FROM pages) WHERE ends_with(name, '.pdf')")
def pdf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".PDF").otherwise(".txt")
    return S.read(spark, sf_dir, "pages").select("page_id", F.concat("url", kind).alias("name")).where(F.col("name").endswith(".pdf"))


@query("SELECT page_id, split_part(url, '/', -1) AS segment FROM pages")
def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "pages").select("page_id", X.last_segment(F.col("url")).alias("segment"))


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS ordinal FROM pages")
def progress_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordinals(S.read(spark, sf_dir, "pages").select("page_id"), "page_id")


@query(f"""WITH {PRICES}, {REPORTS}, {priced()} SELECT report_id, k, v FROM (SELECT report_id, unnest(['base_date', 'future_date', 'label']) AS k,
    unnest([strftime(base_date, '%Y-%m-%d'), strftime(future_date, '%Y-%m-%d'), CASE WHEN pct <= -5.0 THEN '{N.PROTOTYPE_TEXTS[1]}' ELSE '{N.PROTOTYPE_TEXTS[0]}' END]) AS v FROM rated WHERE status = 'ok')""")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = labeling.label_table(S.reports(spark, sf_dir), S.prices(spark, sf_dir)).where("status = 'ok'").withColumnRenamed("label_text", "label")
    return wide.unpivot("report_id", ["base_date", "future_date", "label"], "k", "v")


@query(r"""SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN chr(9) || ' ' || chr(10) ELSE text END AS text, lang FROM documents)
    WHERE lang = 'en' AND length(text) >= 200 AND regexp_matches(text, '\S')""")
def form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a form with two fields asks for, blank ones left out."""
    docs = S.read(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 10 == 3, "\t \n").otherwise(F.col("text")))
    return L.asked_texts(spark, docs, "lang = :lang AND length(text) >= :least", lang="en", least=200).select("doc_id", "text")


# ---- predictions ----------------------------------------------------------------------------------------------------
_LOGITS = """l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    p AS (SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS c, 100.0::DOUBLE * exp(greatest(a, b) - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS conf FROM l)"""


@query(f"WITH {_LOGITS} SELECT vec_id, c AS pred_class, CASE c WHEN 0 THEN '{N.CLASS_TEXTS[0]}' ELSE '{N.CLASS_TEXTS[1]}' END AS pred_label, round(conf, 6) AS confidence FROM p")
def softmax_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.predictions(S.logits(spark, sf_dir)).select("vec_id", "pred_class", "pred_label", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_LOGITS} SELECT vec_id, CASE c WHEN 0 THEN 'success' ELSE 'error' END AS panel, format('{{:.1f}}', conf) AS shown, trunc(conf) / 100 AS progress FROM p")
def confidence_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.result_panel(R.predictions(S.logits(spark, sf_dir))).select("vec_id", "panel", "shown", "progress")


@query("SELECT 'models/' || arg_max(event_type || '_' || CAST(event_id AS VARCHAR), ts) AS path, max(ts) AS modified_at FROM events WHERE event_id % 3 <> 0")
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_model(S.registry(spark, sf_dir))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:128] AS t FROM documents), n AS (SELECT max(len(t)) AS n FROM t)
    SELECT doc_id, array_to_string(list_concat(t, list_transform(range(0, n - len(t)), lambda x: '[PAD]')), ' ') AS tokens FROM t, n""")
def tokens_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.padded_tokens(S.read(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# ---- whole plans ----------------------------------------------------------------------------------------------------
_FOUND = f"""{TEXTS}, sq AS (SELECT report_id, raw_text, {squeezed('raw_text')} AS t FROM texts),
    meta AS (SELECT report_id, raw_text, {code_sql('t')} AS ticker, {date_sql('t')} AS ds FROM sq),
    found AS (SELECT report_id, raw_text, ticker, CAST(try_strptime(ds, '%Y.%m.%d') AS DATE) - INTERVAL 25 YEAR AS rdt FROM meta WHERE ticker IS NOT NULL AND ds IS NOT NULL),
    reports AS (SELECT report_id, raw_text, ticker, CAST(rdt AS DATE) AS rd FROM found WHERE rdt IS NOT NULL)"""


@query(f"WITH {PRICES}, {_FOUND}, {priced()} SELECT report_id, {chain_sql('raw_text', X.FULL)} AS text, CASE WHEN pct <= -5.0 THEN 1 ELSE 0 END AS label FROM rated JOIN texts USING (report_id) WHERE status = 'ok'")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_set(S.report_texts(spark, sf_dir), S.prices(spark, sf_dir), AHEAD)


@query(f"WITH {PRICES}, {_FOUND}, {priced()} SELECT coalesce(status, 'no metadata') AS status, count(*) AS n FROM texts LEFT JOIN rated USING (report_id) GROUP BY 1")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.batch_report(S.report_texts(spark, sf_dir), S.prices(spark, sf_dir), AHEAD)


@query("""WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)), r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM labels)
    SELECT doc_id, toxic FROM r, n WHERE k <= n""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.balanced(S.read(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


def _shown_predictions(rows: DataFrame) -> DataFrame:
    logit = lambda k: (F.round(F.get("logits", k), 6) + 0).alias(f"logit_{k}")
    return rows.select("doc_id", logit(0), logit(1), "pred_class", "pred_label", F.round("confidence", 6).alias("confidence"))


_BATCH = f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % {linear.BATCHES}"


@query(f"""WITH {LSQL.features("f", "doc_id", "documents")}, r AS MATERIALIZED (SELECT row_number() OVER () AS k, b, x, CAST(toxic AS DOUBLE) AS y, {_BATCH} AS batch FROM f JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
    {LSQL.trained()} {LSQL.predicted("f", "weights", "doc_id")}""")
def train_predict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents and predicts for all."""
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = S.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    made = linear.train(docs.join(labels, "doc_id"), key="doc_id")
    return _shown_predictions(linear.predict(docs, made.weights))


@query(f"""WITH {LSQL.features("f", "doc_id", "documents")}, o AS (SELECT unnest(b) AS bucket, toxic FROM f JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
    n AS (SELECT bucket, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM o GROUP BY bucket), t AS (SELECT sum(n1) AS t1, sum(n0) AS t0 FROM n),
    weights AS (SELECT bucket, round(ln((n1 + 1)::DOUBLE / (t1 + {linear.BUCKETS})::DOUBLE) - ln((n0 + 1)::DOUBLE / (t0 + {linear.BUCKETS})::DOUBLE), 6) AS weight FROM n, t
                UNION ALL SELECT {linear.BIAS}, round(ln((count(*) FILTER (WHERE toxic = 1) + 1)::DOUBLE / (count(*) FILTER (WHERE toxic = 0) + 1)::DOUBLE), 6) FROM labels JOIN documents USING (doc_id))
    {LSQL.predicted("f", "weights", "doc_id")}""")
def counted_predict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from counts of words by class, in one pass, and predictions for all documents."""
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = S.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return _shown_predictions(linear.predict(docs, linear.counted(docs.join(labels, "doc_id"))))


# ---- the same in SQL alone ------------------------------------------------------------------------------------------
@query(ORACLE["clean_full"])
def sql_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    Q.register(spark)
    return spark.sql("SELECT report_id, clean_report(raw_text) AS clean FROM {texts}", texts=S.report_texts(spark, sf_dir))


@query(ORACLE["drop_missing_metadata"])
def sql_found_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    Q.register(spark)
    return spark.sql("SELECT report_id, ticker, report_date_str FROM {texts}, LATERAL report_metadata(raw_text) WHERE ticker <> '' AND report_date_str <> ''", texts=S.report_texts(spark, sf_dir))


@query(ORACLE["label_reports"])
def sql_label_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    Q.register(spark)
    Q.register_prices(spark, S.prices(spark, sf_dir))
    return spark.sql(f"""SELECT report_id, base.trade_date AS base_date, base.close AS base_close, future.trade_date AS future_date, future.close AS future_close,
            shown_pct(return_pct(base.close, future.close)) AS return_pct, label_of(return_pct(base.close, future.close)) AS label_id
        FROM (SELECT report_id, first_price(prices, report_date, date_add(report_date, {N.HORIZON + N.TOLERANCE})) AS base,
                     first_price(prices, date_add(report_date, {N.HORIZON}), date_add(report_date, {N.HORIZON + N.TOLERANCE})) AS future
              FROM {{reports}} r JOIN price_blocks({N.HORIZON + N.TOLERANCE}) p ON p.ticker = r.ticker AND p.block = price_block(r.report_date)) WHERE future IS NOT NULL""", reports=S.reports(spark, sf_dir))
