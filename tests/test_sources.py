"""Fetching and page tables."""

from __future__ import annotations

from quire.sources import http


def test_retries():
    seen, slept = [], []

    def get(url):
        seen.append(url)
        if url.endswith("down"):
            raise OSError
        return {"gone": (404, b"", {}), "busy": (429 if seen.count(url) < 2 else 200, b"x", {"Retry-After": "7"})}[url]

    assert http.fetched("gone", get)["outcome"] == "absent"
    assert http.fetched("busy", get, slept.append)["outcome"] == "ok" and slept == [7.0]
    assert http.fetched("down", get, slept.append)["outcome"] == "unavailable" and slept == [7.0, 1.0, 2.0]


def test_fetch_lookups_and_batches(spark):
    works = spark.createDataFrame([("a", "10.1/x", None, "T"), ("b", None, "1706.03762", "T"), ("c", None, None, "A title")], "work string, doi string, arxiv_id string, title string")
    urls = http.lookups(works)
    assert {(r["work"], r["source"]) for r in urls.collect()} == {("a", "crossref"), ("a", "semanticscholar"), ("b", "arxiv"), ("b", "semanticscholar"), ("c", "title")}
    out = http.fetch(urls, lambda url: (200, url.encode(), {}) if "crossref" in url else (404, b"", {}), {})
    assert {r["outcome"]: r["n"] for r in http.unavailable(out).collect()} == {"ok": 1, "absent": 4}
    ids = spark.range(1200).selectExpr("cast(id as string) ident").coalesce(1)
    sizes = [len(r["idents"]) for r in http.batches(ids).collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 500
    both = spark.createDataFrame([(["x", "y"], ["1", None])], "idents array<string>, payloads array<string>")
    assert [(r["ident"], r["payload"]) for r in http.positional(both).collect()] == [("x", "1")]


def test_sampled_pages(spark):
    pages = spark.createDataFrame([("d", i, f"PAGE{i:04d}") for i in range(200)] + [("s", 0, "only")], "doc string, page int, text string")
    got = {r["doc"]: r for r in http.sampled_text(pages).collect()}
    assert got["s"]["text"] == "only" and got["d"]["pages_read"] == 10 and got["d"]["text"].startswith("PAGE0000") and "PAGE0199" in got["d"]["text"] and "not read" in got["d"]["text"]


def test_a_session_without_a_shared_folder_gets_a_local_one(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from quire.session import session\nfrom quire.sources.storage import shared_root, staged\n"
        "s = session('local[1]', spark__ui__enabled='false')\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert staged(s.range(3), 't').count() == 3 and shared_root(s) == shared_root(s)\nprint('kept', shared_root(s))"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "kept file:" in done.stdout, done.stderr[-2000:]
