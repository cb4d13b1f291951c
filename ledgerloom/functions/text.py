"""Text expressions: security codes, dates and cleaning chains.

Patterns are written for Java with Python's meaning: (?U) takes all Unicode digits, letters and spaces, (?d) ends lines
at line feeds only, and SPACE adds the four separators that only Python counts as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

# Months by their English abbreviations.
MONTHS = {
    "Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04", "May": "05", "Jun": "06",
    "Jul": "07", "Aug": "08", "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12",
}
# A six-digit security code, a numeric date and an English date.
CODE = r"(?U)(?<!\d)([0-9]{6})(?!\d)"
NUMERIC_DATE = rf"(?U)(202[0-6]|2[0-6])[.\-/]{SPACE}*(0[1-9]|1[0-2])[.\-/]{SPACE}*(0[1-9]|[12]\d|3[01])"
ENGLISH_DATE = rf"(?iU)({'|'.join(MONTHS)})[a-z]*{SPACE}+(\d{{1,2}}),{SPACE}*(202[0-6])"

# What cleaning takes out, in the order in which it does; (step, pattern, replacement).
JOIN_LINES = ("CLN1", r"(?<!\.)\n", " ")
EMAIL = ("CLN2", r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+", "")
SPACED_ENGLISH = ("CLN3", rf"(?dU)[A-Za-z]{SPACE}[A-Za-z]{SPACE}[A-Za-z].*?(?=[가-힣])", "")
PHONE = ("CLN4", r"(?U)\d{2,3}-\d{3,4}-\d{4}", "")
DOTTED_DATE = ("CLN5", r"(?U)\d{4}\.\d{2}\.\d{2}", "")
SIX_DIGITS = ("CLN6", r"(?U)\b\d{6}\b", "")
FIGURES = [
    ("CLN7a", r"(?dU)목표주가.*?\d+원", ""),
    ("CLN7b", r"(?dU)현재주가.*?\d+원", ""),
    ("CLN7c", r"(?d)상승여력.*?%", ""),
    ("CLN7d", r"(?d)KOSPI.*?[pP][tT]", ""),
    ("CLN7e", r"(?d)시가총액.*?[억백십만]+원", ""),
    ("CLN7f", r"(?d)발행주식수.*?[주]", ""),
    ("CLN7g", r"(?d)액면가.*?원", ""),
    ("CLN7h", r"(?d)자본금.*?원", ""),
    ("CLN7i", r"(?d)60일 평균거래.*", ""),
    ("CLN7j", rf"(?U)매수{SPACE}*\([가-힣]+\)", ""),
    ("CLN7k", r"Stock Data", ""),
]
COLLAPSE = ("CLN8", rf"(?U){SPACE}+", " ")

BODY = [SPACED_ENGLISH, PHONE, DOTTED_DATE, SIX_DIGITS, *FIGURES]
#: The cleaning of the batch run, and the two forms of the prototype, whose results differ.
FULL = [JOIN_LINES, EMAIL, *BODY, COLLAPSE]
PROTOTYPE_BASIC = [JOIN_LINES, COLLAPSE, EMAIL]
PROTOTYPE_FULL = [*BODY, ("LINES", r"\n", " "), COLLAPSE]


def apply_rules(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    """One expression that applies the rules in order."""
    for _, pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip(c: Column) -> Column:
    """Without white space at both ends, in Python's sense of white space."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def clean_report(c: Column) -> Column:
    return strip(apply_rules(c, FULL))


def clean_prototype_basic(c: Column) -> Column:
    return strip(apply_rules(c, PROTOTYPE_BASIC))


def clean_prototype_full(c: Column) -> Column:
    return strip(apply_rules(c, PROTOTYPE_FULL))


def squeeze_digits(c: Column) -> Column:
    """Without white space between two digits."""
    return F.regexp_replace(c, rf"(?U)(?<=\d){SPACE}+(?=\d)", "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first(c: Column, pattern: str, k: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def security_code(c: Column) -> Column:
    """The first run of exactly six digits of a squeezed text, else null."""
    return _first(c, CODE, 1)


def numeric_date(c: Column) -> Column:
    """The first numeric date as yyyy.MM.dd, else null."""
    part = lambda m, k: F.get(F.split(m, rf"(?U)[.\-/]{SPACE}*"), k)
    year = lambda m: F.when(F.length(part(m, 0)) == 2, F.concat(F.lit("20"), part(m, 0))).otherwise(part(m, 0))
    return let(_first(c, NUMERIC_DATE), lambda m: F.when(m.isNotNull(), F.concat_ws(".", year(m), part(m, 1), part(m, 2))))


def english_date(c: Column) -> Column:
    """The first English date as yyyy.MM.dd, else null; its day is not checked."""
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def normal(m: Column) -> Column:
        month = F.element_at(months, F.initcap(F.substring(m, 1, 3)))
        return F.when(m.isNotNull(), F.concat_ws(".", F.right(m, F.lit(4)), month, F.lpad(F.regexp_extract(m, r"(?U)(\d{1,2}),", 1), 2, "0")))

    return let(_first(c, ENGLISH_DATE), normal)


def report_date(c: Column) -> Column:
    """An English date wins wherever it stands, even one that is none."""
    return let(english_date(c), lambda e: F.when(e.isNotNull(), e).otherwise(numeric_date(c)))


def missing(c: Column) -> Column:
    """Null and empty alike."""
    return F.nullif(c, F.lit("")).isNull()


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def preview(c: Column, n: int = 1000) -> Column:
    return F.substring(c, 1, n)


def join_pages(pages: Column) -> Column:
    """Pages in order with line feeds between; null and empty pages are left out, blank ones stay."""
    return F.array_join(F.filter(pages, lambda p: p.isNotNull() & (p != "")), "\n")


# Characters that a file name must not have.
NOT_IN_NAMES = '\\/:*?"<>|'


def file_title(c: Column) -> Column:
    return F.translate(strip(c), NOT_IN_NAMES, "")


def file_path(folder: str, title: Column) -> Column:
    return F.concat_ws("/", F.lit(folder), F.concat(title, F.lit(".pdf")))


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def resolve_link(href: Column, host: str) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(host), href))


def listing_url(base: str, page: Column) -> Column:
    """The URL of a listing's page."""
    return F.concat(F.lit(f"{base}?&page="), page.cast("string"))


def tokens(c: Column, most: int = 128) -> Column:
    """The first words of a text."""
    return F.slice(F.filter(F.split(c, rf"(?U){SPACE}+"), lambda t: t != ""), 1, most)


def padded(tokens: Column, length: Column, pad: str = "[PAD]") -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(tokens)).cast("int")))
