"""Polite fetching, crawls that go on where one ended, and the functions of a session."""

import http.server
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import sql as Q
from ledgerloom.functions import text as X
from ledgerloom.plans import training
from ledgerloom.sources import fetching
from ledgerloom.sources import fixtures as S
from ledgerloom.sources import listings as L


class Site:
    """Twelve reports on two listing pages; one fails at first, one always, one isn't there. Keeps when it was asked for what."""

    def __init__(self):
        self.asked: list[tuple[float, str]] = []
        row = lambda k: f'<tr><td>x</td><td><a href="/v">Report {k}</a></td><td class="file"><a href="/r/{k}">pdf</a></td></tr>'
        self.rows = {1: [*map(row, range(6))], 2: [*map(row, range(6, 12))]}
        site = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked.append((time.monotonic(), self.path))
                n = sum(p == self.path for _, p in site.asked)
                if self.path.startswith("/list"):
                    code, body = 200, f'<table class="type_1">{"".join(site.rows[int(self.path[-1])])}</table>'.encode()
                else:
                    k = int(self.path.rsplit("/", 1)[1])
                    code, body = (404 if k == 5 else 503 if k == 7 or k == 3 and n == 1 else 200), b"report %d" % k
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.at = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    made = Site()
    yield made
    made.server.shutdown()


def test_a_crawl_keeps_its_pace_and_goes_on(spark, site, tmp_path):
    folder = str(tmp_path / "pdf")
    crawl = lambda: training.crawl(spark, f"{site.at}/list", site.at, folder, 1, 2, per_second=10, wait=0.01)
    rows = {r["title"]: r["error"] for r in crawl().collect()}
    assert len(rows) == 12 and {t for t, e in rows.items() if e} == {"Report 5", "Report 7"}
    assert {p.name: p.read_bytes() for p in (tmp_path / "pdf").iterdir()} == {f"Report {k}.pdf": b"report %d" % k for k in range(12) if k not in (5, 7)}
    times = [t for t, _ in site.asked]
    counts = Counter(p for _, p in site.asked)
    assert all(sum(t <= x < t + 1 for x in times) <= 11 for t in times)  # ten a second, and one at the edge
    assert counts.pop("/r/3") == 2 and counts.pop("/r/7") == 3 and set(counts.values()) == {1}  # none twice but what failed
    site.asked.clear()
    again = crawl().collect()
    assert sorted(p for _, p in site.asked) == sorted(["/list?&page=1", "/list?&page=2", "/r/5", *["/r/7"] * 3])
    assert len(again) == 12 and {r["title"] for r in again if r["error"]} == {"Report 5", "Report 7"}
    # a title that is linked to another report is fetched anew
    site.rows[2].append('<tr><td>x</td><td><a href="/v">Report 1</a></td><td class="file"><a href="/r/20">pdf</a></td></tr>')
    site.asked.clear()
    crawl().collect()
    assert "/r/20" in {p for _, p in site.asked} and (tmp_path / "pdf" / "Report 1.pdf").read_bytes() == b"report 20"


def test_pace_and_tries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = fetching.Pace(4, lambda: now[0], sleep)
    for _ in range(9):
        pace.take()
    assert now[0] == pytest.approx(2.0) and len(slept) == 8
    now[0] += 100  # a long rest saves up no more than one token
    pace.take()
    pace.take()
    assert now[0] == pytest.approx(102.25)
    calls = []

    def fails(url):
        calls.append(url)
        raise OSError("down")

    slept.clear()
    assert fetching.got("u", fails, fetching.Pace(1e9, lambda: now[0], sleep), 4, 1.0) == (None, "down", 4) and len(calls) == 4
    assert [s for s in slept if s >= 1] == [1.0, 2.0, 4.0]


def test_fetch_rows(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no")
        return url.encode()

    urls = [(1, "http://a/x"), (2, "http://b/bad"), (3, None), (4, "plain"), (4, "plain")]
    rows = fetching.fetch(spark.createDataFrame(urls, "id int, url string").withColumn("error", F.lit("old")), get, per_second=1000, lanes=2, wait=0).collect()
    got = sorted((r["id"], r["content"] and bytes(r["content"]), r["error"], r["tries"]) for r in rows)
    assert got == [(1, b"http://a/x", None, 1), (2, None, "no", 3), (3, None, "no URL", 0), (4, b"plain", None, 1), (4, b"plain", None, 1)]
    assert fetching.fetch(spark.createDataFrame([], "url string"), get).count() == 0


TEXTS = ["", None, "(A000660) 24.05.29", "a 2 0 2 4.05. 29 b 042700", "Mar 5, 2024 and 2023-01-02", "summary 18, 2024", "123456은 123456 x", "목표주가 1,500원 a.\nb KOSPI 2 pT x\n60일 평균거래 y", "  a@b.co  \x1c　x ", "B u y it 한글", 'a/b:"c"?', "it's"]


def test_functions_of_a_session(spark, sf_dir):
    """Each function gives what the column expression gives, and none needs Python."""
    Q.register(spark)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").unionByName(S.report_texts(spark, sf_dir).select(F.col("raw_text").alias("t")).limit(200))
    t = F.col("t")
    same = {
        "squeeze_digits": X.squeeze_digits(t), "security_code": X.security_code(t), "numeric_date": X.numeric_date(t), "english_date": X.english_date(t), "report_date_text": X.report_date(t),
        "to_report_date": N.to_report_date(t), "clean_report": X.clean_report(t), "clean_prototype_basic": X.clean_prototype_basic(t), "clean_prototype_full": X.clean_prototype_full(t),
        "is_blank_text": X.is_blank(t), "file_title": X.file_title(t),
    }
    for name, column in same.items():
        assert rows.where(~F.expr(f"{name}(t)").eqNullSafe(column)).count() == 0, name
    pcts = spark.createDataFrame([(100.0, 95.0), (0.0, 1.0), (100.0, 95.001), (None, 1.0)], "b double, f double")
    got = pcts.selectExpr("return_pct(b, f) AS p", "label_of(return_pct(b, f)) AS l", "class_text(label_of(return_pct(b, f))) AS c", "shown_pct(return_pct(b, f)) AS s").collect()
    assert [(r["l"], r["s"]) for r in got] == [(1, -5.0), (0, None), (0, -5.0), (0, None)] and got[0]["c"] == N.CLASS_TEXTS[1]
    told = spark.sql("SELECT t, m.* FROM {rows}, LATERAL report_metadata(t) m", rows=rows)
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString() and told.count() == rows.count()


def test_asked_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "x' OR '1'='1")], "id int, text string")
    assert [r["id"] for r in L.asked_texts(spark, docs, "id >= :least", least=1).collect()] == [1, 4]
    assert [r["id"] for r in L.asked_texts(spark, docs, "text = :t", t="x' OR '1'='1").collect()] == [4]
    assert L.single_text(spark, " \t").count() == 0 and L.single_text(spark, "좋다").first()["text"] == "좋다"
