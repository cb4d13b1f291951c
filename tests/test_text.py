"""Golden rows for the traps of extraction and cleaning, and properties of the cleaning chain."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.reports import extract_metadata


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize(("raw", "ticker", "date"), [
    ("코드 A042700, 2024.05.29 발간", "042700", "2024.05.29"),
    ("2024.05.29 042700", None, "2024.05.29"),
    ("(123456) 26-05-18", "123456", "2026.05.18"),
    ("1926.05.18 1234567", None, "2026.05.18"),
    ("(1 2 3 4 5 6) 2024/ 05- 09", "123456", "2024.05.09"),
    ("(042700) may 8, 2026 뒤 2024.05.29", "042700", "2026.05.08"),
    ("(042700) summary 18, 2024", "042700", "2024.03.18"),
    ("(042700) Feb 99, 2024", "042700", "2024.02.99"),
    ("1,234567 x 2030.01.01", "234567", None),
    ("2024.5.9", None, None),
    ("", None, None),
    (None, None, None),
])
def test_metadata(spark, raw, ticker, date):
    row = extract_metadata(spark.createDataFrame([(raw,)], "raw_text string")).first()
    assert (row["ticker"], row["report_date_str"]) == (ticker, date)


@pytest.mark.parametrize(("raw", "clean"), [
    ("앞.\n뒤\n끝", "앞. 뒤 끝"),
    ("메일 a.b+c@x-y.co.kr. 다음", "메일 다음"),
    ("a b c 잡음 한글", "잡음 한글"),
    ("no hangul: a b c d", "no hangul: a b c d"),
    ("전화 02-123-4567 끝", "전화 끝"),
    ("날짜 2024.05.29 과 2024-05-29", "날짜 과 2024-05-29"),
    ("코드 123456 과 123456은 1234567", "코드 과 123456은 1234567"),
    ("목표주가 12,500원 좋다", "좋다"),
    ("시가총액 3조 2천억원 끝", "끝"),
    ("60일 평균거래 1만주.\n다음 줄", "다음 줄"),
    ("60일 평균거래 1만주\n같은 줄", ""),
    ("매수 (유지) Stock Data 끝", "끝"),
    ("넓은　 공백\x1c끝", "넓은 공백 끝"),
    ("", ""),
    (None, None),
])
def test_clean_report(spark, raw, clean):
    assert one(spark, X.clean_report, raw) == clean


def test_chains_differ(spark):
    text = "x a@b.co y\n목표주가 1\n원"
    assert one(spark, X.clean_prototype_basic, text) == "x  y 목표주가 1 원"
    assert one(spark, X.clean_prototype_full, text) == "x a@b.co y 목표주가 1 원"


def test_steps_keep_order(spark):
    assert one(spark, X.clean_report, "목표주가 123456원 뒤 900원 끝") == "목표주가 123456원 뒤 900원 끝".replace("목표주가 123456원", "").strip()


def test_titles_links_and_pages(spark):
    assert one(spark, X.file_title, ' \t a\\b/c:d*e?f"g<h>i|j　') == "abcdefghij"
    assert one(spark, lambda c: X.resolve_link(c, "https://h"), "httpx") == "httpx"
    assert one(spark, lambda c: X.resolve_link(c, "https://h"), "/a") == "https://h/a"
    assert one(spark, X.last_segment, "a/b/c") == "c"
    assert one(spark, X.is_blank, "　\n") is True
    pages = spark.createDataFrame([(["a", None, "", " ", "b"],)], "p array<string>")
    assert pages.select(X.join_pages(F.col("p"))).first()[0] == "a\n \nb"


def test_no_python_in_plans(spark, sf_dir):
    from ledgerloom.plans import catalogue

    for name, query in catalogue.QUERIES.items():
        if name in ("html_css_udf", "train_predict_rows"):
            continue
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_each_figure_has_rows_of_each_kind(spark):
    """Every step changes the phrase that it is for, and leaves what it misses and what a line feed parts, but where the step spans lines."""
    from pyspark.sql import functions as F

    from ledgerloom.functions import text as X
    from ledgerloom.plans.catalogue import VARIED

    assert len(VARIED) == len(X.FIGURES)
    for (step, pattern, to), kinds in zip(X.FIGURES, VARIED):
        hit, miss, parted = (r["c"] == "" for r in spark.createDataFrame([(p,) for p in kinds], "t string").select(F.regexp_replace("t", pattern, to).alias("c")).collect())
        assert (hit, miss, parted) == (True, False, step == "CLN7j"), step
