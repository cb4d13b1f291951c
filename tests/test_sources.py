"""Listings, files, models and the stream."""

import datetime as dt

import pytest

from ledgerloom.functions.html import listed
from ledgerloom.operators import model as M
from ledgerloom.operators.reports import balanced, dedup_titles, latest_model
from ledgerloom.plans import catalogue, training
from ledgerloom.sources import fixtures as S
from ledgerloom.sources import listings as L
from ledgerloom.streaming import landing

PAGE = """<table class="type_1 x"><tr><th>t</th></tr>
<tr><td>1</td><td><a href="/v1"> One: <b>two</b> </a></td><td class="file"><a href="/f1.pdf">f</a><a href="/no">g</a></td></tr>
<tr><td>1</td><td>no link</td><td class="file"><a href="/f2.pdf">f</a></td></tr>
<tr><td>1</td><td><a href="/v3">No file</a></td><td><a href="/f3.pdf">f</a></td></tr></table>
<table class="type_2"><tr><td>1</td><td><a href="/v4">Other</a></td><td class="file"><a href="/f4.pdf">f</a></td></tr></table>"""


def test_listed_rows():
    assert listed(PAGE) == [{"title": " One: two ", "href": "/f1.pdf"}]
    assert listed(None) == listed("") == listed("<table class='type_1'><tr><td>") == []


def test_report_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page int, html string")
    rows = L.report_links(pages, "https://h", "d").collect()
    assert [(r["page"], r["title"], r["download_url"], r["path"]) for r in rows] == [(1, "One two", "https://h/f1.pdf", "d/One two.pdf")]
    assert L.listing_urls(spark, "u", 5, 4).count() == 0 and [r["url"] for r in L.listing_urls(spark, "u", 4, 5).collect()] == ["u?&page=4", "u?&page=5"]


def test_fetch_keeps_failures(spark):
    def get(url):
        if url == "bad":
            raise OSError("no")
        return url.encode()

    rows = L.fetch(spark.createDataFrame([("bad",), ("good",)], "url string"), get).collect()
    assert {(r["url"], r["content"] and bytes(r["content"]), r["error"]) for r in rows} == {("bad", None, "no"), ("good", b"good", None)}


def test_files_pages_and_sink(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"one\x0ctwo")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"x")
    files = L.report_files(spark, str(tmp_path))
    assert [r["name"] for r in files.collect()] == ["a.pdf"]
    pages = L.pages_of(files, lambda b: b.decode().split("\x0c")).collect()
    assert [(r["page_no"], r["page_text"]) for r in pages] == [(0, "one"), (1, "two")]
    broken = L.pages_of(files, lambda b: 1 / 0).collect()
    assert broken[0]["page_text"] is None and "zero" in broken[0]["error"]
    out = str(tmp_path / "out")

    def sink():
        import os

        os.makedirs(out, exist_ok=True)
        return lambda path, content: open(f"{out}/{path}", "wb").write(content)

    L.save_reports(spark.createDataFrame([("x.pdf", bytearray(b"1"))], "path string, content binary"), sink)
    assert (tmp_path / "out" / "x.pdf").read_bytes() == b"1"


def test_dedup_keeps_last(spark):
    rows = spark.createDataFrame([("t", 1, 0, "a"), ("t", 2, 0, "c"), ("t", 1, 9, "b"), ("u", 1, 1, "d")], "title string, page int, row_idx int, v string")
    assert sorted(map(tuple, dedup_titles(rows, "title", ["page", "row_idx"], "v").collect())) == [("t", "c", 3), ("u", "d", 1)]


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("좋다 매우 좋다", 0.0), ("나쁘다 매우", 1.0)] * 4, "text string, label double")
    assert M.train(rows.limit(0)) is None
    model = M.train(rows)
    path = M.save(model, str(tmp_path / "models"))
    found = latest_model(L.model_folders(spark, str(tmp_path / "models"))).first()["path"]
    assert found.endswith(path.rsplit("/", 1)[1])
    from pyspark.ml import PipelineModel

    out = M.predict(PipelineModel.load(found), spark.createDataFrame([("좋다",), ("",)], "text string")).collect()
    assert out[0]["pred_class"] == 0 and all(50 <= r["confidence"] <= 100 for r in out)


def test_run_trains_and_saves(spark, sf_dir, tmp_path):
    texts = S.report_texts(spark, sf_dir)
    import pyspark.sql.functions as F

    near = texts.withColumn("raw_text", F.regexp_replace("raw_text", "20(2[0-6])", "20$1"))
    prices = S.prices(spark, sf_dir).withColumn("trade_date", F.add_months("trade_date", 300))
    assert training.run(near.limit(0), prices, str(tmp_path)) is None
    assert training.run(near, prices, str(tmp_path / "m")).startswith(str(tmp_path))


def test_stream(spark, sf_dir, tmp_path):
    texts = S.report_texts(spark, sf_dir)
    texts.write.parquet(str(tmp_path / "in"))
    landing.write(landing.landed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), landing.ready(texts)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_prices_within_bounds(spark, sf_dir, monkeypatch):
    path, every = S.price_table(spark, sf_dir), sorted(map(tuple, S.prices(spark, sf_dir).collect()))
    rows = lambda *bounds: sorted(map(tuple, L.prices(spark, path, *bounds).collect()))
    assert rows() == every and len(every) > 1000
    tickers = sorted({t for t, _, _ in every})
    assert sum((rows(t) for t in tickers), []) == every
    first, last = every[0][1], every[5][1]
    assert rows(tickers[0], str(first), str(last)) == every[:6]
    assert rows(None, None, str(last)) == [r for r in every if r[1] <= last] and rows(None, str(last)) == [r for r in every if r[1] >= last]
    calls, prices = [], L.prices
    monkeypatch.setattr(L, "prices", lambda *given, **bounds: calls.append(bounds) or prices(*given, **bounds))
    got = sorted(map(tuple, catalogue.price_range(spark, sf_dir).collect()))
    assert len(calls) == 1 and got == [r for r in every if 1993 <= r[1].year <= 1997] != [] and {t for t, _, _ in got} == set(tickers)


class Site:
    """A site of two listing pages, one report that is gone and one title twice."""

    def __init__(self):
        import http.server
        import threading

        row = lambda title, href: f'<tr><td>x</td><td><a href="/v">{title}</a></td><td class="file"><a href="{href}">pdf</a></td></tr>'
        table = lambda *rows: f'<table class="type_1"><tr><th>h</th></tr>{"".join(rows)}</table>'.encode()
        pages = {"/list?&page=1": table(row("One: a", "/r/1"), row("Two", "/r/2")), "/list?&page=2": table(row("Two", "/r/3"), row("Gone", "/r/404")), "/r/1": b"first", "/r/2": b"second", "/r/3": b"third"}
        self.agents = agents = set()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                agents.add(self.headers["User-Agent"])
                found = pages.get(self.path)
                self.send_response(200 if found else 404)
                self.end_headers()
                self.wfile.write(found or b"")

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.at = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_crawl_of_a_site(spark, tmp_path):
    site = Site()
    try:
        rows = training.crawl(spark, f"{site.at}/list", site.at, str(tmp_path / "pdf"), 1, 3).collect()
    finally:
        site.server.shutdown()
    assert site.agents == {L.USER_AGENT}
    told = {(r["title"], r["download_url"]): r["error"] for r in rows}
    assert told.pop(("Gone", f"{site.at}/r/404")) and told.pop((None, f"{site.at}/list?&page=3"))
    assert told == {("One a", f"{site.at}/r/1"): None, ("Two", f"{site.at}/r/3"): None}
    assert {p.name: p.read_bytes() for p in (tmp_path / "pdf").iterdir()} == {"One a.pdf": b"first", "Two.pdf": b"third"}


def test_folder_to_model_and_prediction(spark, tmp_path):
    texts = {f"r{k}.pdf": f"({k:06d}) 2024.05.{k + 10}\n실적이 좋다 {'매우' if k % 2 else '나쁘다'}." for k in range(1, 9)} | {"none.pdf": "no code", "bad.pdf": "broken", "note.txt": "x"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())

    def read(content: bytes):
        if content == b"broken":
            raise ValueError("broken")
        return content.decode().split("\n")

    day = lambda k: dt.date(2024, 5, k + 10)
    prices = [(f"{k:06d}", d, c) for k in range(1, 9) for d, c in ((day(k), 100.0), (day(k) + dt.timedelta(days=30), 80.0 if k % 2 else 120.0))]
    prices = spark.createDataFrame(prices, "ticker string, trade_date date, close double")
    path, counts = training.run_folder(spark, str(tmp_path / "in"), prices, str(tmp_path / "models"), read)
    assert counts == {"ok": 8, "no metadata": 1, "error": 1}
    out = M.predict_with_latest(spark.createDataFrame([("실적이 좋다",)], "text string"), str(tmp_path / "models")).first()
    assert len(out["logits"]) == 2 and out["pred_class"] == int(out["logits"][1] > out["logits"][0]) and path.startswith(str(tmp_path / "models"))
    assert training.run_folder(spark, str(tmp_path / "in"), prices.limit(0), str(tmp_path / "models"), read)[0] is None


def test_no_model_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no trained model"):
        M.load_latest(spark, str(tmp_path))


def test_pages_by_the_default_reader(spark, tmp_path):
    pytest.importorskip("pdfplumber")
    stream = b"BT /F1 12 Tf 10 100 Td (Report text) Tj ET"
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 300 200]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Length %d>>stream\n%s\nendstream" % (len(stream), stream), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    body, at = b"%PDF-1.4\n", []
    for k, part in enumerate(parts, 1):
        at.append(len(body))
        body += b"%d 0 obj\n%s\nendobj\n" % (k, part)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    (tmp_path / "a.pdf").write_bytes(body + b"xref\n0 6\n0000000000 65535 f \n" + table + b"trailer<</Size 6/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % len(body))
    assert "Report text" in L.pages_of(L.report_files(spark, str(tmp_path))).first()["page_text"]


def test_balanced_classes(spark):
    rows = [(k, k % 7 // 5) for k in range(500)] + [(1000 + k, None) for k in range(150)]
    got = balanced(spark.createDataFrame(rows, "id long, label int"), "label", "id").collect()
    want = [r for c in (0, 1, None) for r in sorted(r for r in rows if r[1] == c)[:142]]
    assert sorted(tuple(r) for r in got if r[1] is not None) == sorted(r for r in want if r[1] is not None) and len(got) == len(want)


def test_ordinals(spark):
    """Places in order: uneven keys, ties, nulls first, more rows than a range; no row and one."""
    import random

    from ledgerloom.operators.reports import ordinals

    keys = [k * k for k in range(9000)] + [7] * 40 + [-3, None]
    random.Random(1).shuffle(keys)
    rows = ordinals(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int"), "k").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["ordinal"])] == [None, *sorted(k for k in keys if k is not None)]
    assert sorted(r["ordinal"] for r in rows) == list(range(1, len(keys) + 1))
    one = spark.createDataFrame([(5,)], "k long")
    assert [r["ordinal"] for r in ordinals(one, "k").collect()] == [1] and ordinals(one.limit(0), "k").collect() == []
