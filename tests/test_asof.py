"""Golden rows for price lookups and labels."""

import datetime as dt

import pytest

from ledgerloom.operators.labeling import label_reports, label_table, status_counts

DAY = dt.date(2024, 1, 1)
at = lambda n: DAY + dt.timedelta(days=n)


def labelled(spark, prices, reports=((1, "a", DAY),)):
    p = spark.createDataFrame([("a", at(n), None if c is None else float(c)) for n, c in prices], "ticker string, trade_date date, close double")
    r = spark.createDataFrame(list(reports), "report_id long, ticker string, report_date date")
    return r, p


@pytest.mark.parametrize(("prices", "want"), [
    ([], None),
    ([(0, 100)], None),
    ([(51, 100)], None),
    ([(30, 80)], (80.0, 80.0, 0.0, 0)),
    ([(0, 100), (30, 95)], (100.0, 95.0, -5.0, 1)),
    ([(0, 100), (30, 95.001)], (100.0, 95.001, -5.0, 0)),
    ([(0, 100), (29, 1), (50, 90)], (100.0, 90.0, -10.0, 1)),
    ([(0, 100), (51, 90)], None),
    ([(0, 0), (31, 90)], (0.0, 90.0, None, 0)),
    ([(-1, 7), (3, 100), (3, 90), (40, 99)], (90.0, 99.0, 10.0, 0)),
    ([(0, None), (2, 100), (31, 90)], (None, 90.0, None, 0)),
    ([(0, 100), (31, None), (32, 90)], (100.0, None, None, 0)),
])
def test_labels(spark, prices, want):
    rows = label_reports(*labelled(spark, prices)).collect()
    assert [(r["base_close"], r["future_close"], r["return_pct"], r["label_id"]) for r in rows] == ([want] if want else [])


def test_statuses(spark):
    reports = [(1, "a", DAY), (2, "b", DAY), (3, "a", None), (4, "a", at(-25)), (5, None, DAY)]
    r, p = labelled(spark, [(0, 100), (30, 90)], reports)
    got = {x["status"]: x["n"] for x in status_counts(r, p).collect()}
    assert got == {"ok": 1, "no price": 2, "no later price": 1, "bad date": 1}
    assert label_table(r, p).count() == 5


def test_properties(spark, sf_dir):
    from ledgerloom.sources import fixtures as S

    rows = label_reports(S.reports(spark, sf_dir), S.prices(spark, sf_dir))
    assert rows.where("future_date < base_date OR base_date < report_date OR future_date > date_add(report_date, 50)").isEmpty()
    assert rows.where("(return_pct < -5.01) <> (label_id = 1) AND abs(return_pct + 5) > 0.01").isEmpty()
