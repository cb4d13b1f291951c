"""Report files that land in several triggers, late and more than once, end as one batch would have them."""

import os

from ledgerloom.streaming import landing

DAY = 86_400


def put(folder, sub, title, content, day):
    path = folder / sub / title
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (1_700_000_000 + day * DAY,) * 2)


def saved(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()} if folder.exists() else {}


def run(spark, tmp_path, **more):
    query = landing.keep_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), **more)
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_late_and_repeated_files(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    put(source, "a", "one.pdf", b"one 3", 3)
    put(source, "a", "two.pdf", b"two 3", 3)
    put(source, "a", "note.txt", b"no report", 3)
    run(spark, tmp_path)
    assert saved(out) == {"one.pdf": b"one 3", "two.pdf": b"two 3"}
    put(source, "b", "one.pdf", b"one 1, late", 1)
    put(source, "c", "one.pdf", b"one 2, late", 2)
    put(source, "b", "two.pdf", b"two 3, a greater path", 3)
    put(source, "b", "three.pdf", b"three", 2)
    run(spark, tmp_path, files_per_trigger=1)
    want = {"one.pdf": b"one 3", "two.pdf": b"two 3, a greater path", "three.pdf": b"three"}
    assert saved(out) == want
    put(source, "d", "one.pdf", b"one 5", 5)
    put(source, "d", "two.pdf", b"two 2, late", 2)
    run(spark, tmp_path)
    want["one.pdf"] = b"one 5"
    assert saved(out) == want == {r["path"]: bytes(r["content"]) for r in landing.last_files(spark, str(source)).collect()}
    run(spark, tmp_path)  # nothing new
    assert saved(out) == want


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Titles that lie far behind the latest file leave the state; files that are too late change nothing."""
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(20):
        put(source, "a", f"t{k}.pdf", b"old", 0)
    run(spark, tmp_path, late="1 day")
    put(source, "b", "new.pdf", b"new", 30)
    run(spark, tmp_path, late="1 day")
    put(source, "c", "new.pdf", b"newer", 31)
    put(source, "c", "t1.pdf", b"much too late", 2)
    query = run(spark, tmp_path, late="1 day")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in (query.recentProgress or []) if p["stateOperators"]]
    assert rows and rows[-1] <= 2
    assert saved(out) == {f"t{k}.pdf": b"old" for k in range(20)} | {"new.pdf": b"newer"}
