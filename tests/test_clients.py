"""Recorded index answers as a data source, and the inbox as a stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quire.sources import index_client
from quire.streaming.inbox import Inbox


def test_windows_decide_which_pages_are_read(spark, tmp_path):
    rows = [(h, y, p, f"{h}{y}{p}é") for h in ("a.org", "b.org") for y in (1999, 2000, 2001) for p in range(3)]
    assert index_client.record(spark.createDataFrame(rows, "host string, year int, page int, payload string"), str(tmp_path)) == 18
    some = index_client.recorded(spark, str(tmp_path), {"a.org": 2.5}, hosts=("a.org",), year_from=2000, year_to=2000, pages_per_task=2)
    got = sorted(map(tuple, some.where("page <> 1").collect()))
    # Only the year's pages are asked for, in order and spaced; filters on top leave the source as it is.
    assert got == [("a.org", 2000, 0, 0.0, "a.org20000é"), ("a.org", 2000, 2, 5.0, "a.org20002é")] and some.count() == 3
    every = index_client.recorded(spark, str(tmp_path), {"a.org": 2.5})
    assert every.count() == 18 and every.where("host = 'a.org'").agg(F.max("asked_at")).first()[0] == 20.0
    assert index_client.recorded(spark, str(tmp_path), hosts=("c.org",)).collect() == []


ENTRIES = "key string, title string, doi string, arxiv_id string, status string"


def test_files_are_filed_once_and_moved_last(spark, tmp_path):
    entries = spark.createDataFrame([("known2000", "A known work of art", None, None, "unread"), ("looseleaf", "x", None, None, "verified")], ENTRIES)
    inbox, dropped = Inbox(spark, f"file://{tmp_path}/log", lambda: entries), tmp_path / "in"
    dropped.mkdir()
    put = lambda name, text: (dropped / name).write_text(text)
    put("a.txt", "A known work of art\n\nIts text.")
    put("b.txt", "Loose leaf\nOne text of it")
    put("c.txt", "Loose leaf\nAnother text of it")
    put("d.txt", " \n ")
    put("e.txt", "A known work of art\n\nIts text.")

    def run(**more):
        query = inbox.stream(str(dropped), str(tmp_path / "cp"), **more)
        query.processAllAvailable()
        query.stop()

    run()
    status = lambda: {os.path.basename(r["path"]): (r["key"], r["status"]) for r in inbox.filed().collect()}
    first = {"a.txt": ("known2000", "updated"), "b.txt": ("looseleafa", "added"), "c.txt": ("looseleafa", "updated"), "d.txt": (None, "unreadable"), "e.txt": ("known2000", "repeated")}
    assert status() == first
    # The stream dies before it commits its batch, and starts again: nothing is filed twice, and now files move.
    for name in ("0", ".0.crc"):
        os.remove(tmp_path / "cp/commits" / name)
    put("f.txt", "Loose leaf\nA third text")
    run(filed_folder=str(tmp_path / "done"))
    assert status() == first | {"f.txt": ("looseleafa", "updated")}
    assert sorted(os.listdir(tmp_path / "done")) == ["known2000--a.txt", "known2000--e.txt", "looseleafa--b.txt", "looseleafa--c.txt", "looseleafa--f.txt"]
    assert [n for n in os.listdir(dropped) if n.endswith(".txt")] == ["d.txt"] and inbox.move(0, str(tmp_path / "done")) == 0
    texts = {r["key"]: r["n"] for r in inbox.log.read("texts").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert texts == {"known2000": 1, "looseleafa": 3}


def test_resolvers_are_asked_by_doi_and_fail_alone(spark):
    import pytest

    from quire.sources.resolvers import register_resolver, template

    def resolve(doi):
        if doi.endswith("x"):
            raise LookupError("no such shelf")
        return [f"https://a.org/{doi}", "", f"https://b.org/{doi}"]

    register_resolver(spark, "shelf", resolve)
    works = spark.createDataFrame([(1, "10.1/a"), (2, "10.1/x"), (3, None), (4, " ")], "work int, doi string")
    rows = spark.sql("SELECT w.work, r.place, r.url, r.label, r.error FROM {w} w, LATERAL shelf(w.doi) r ORDER BY work, place", w=works).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "https://a.org/10.1/a", "shelf", None), (1, 1, "https://b.org/10.1/a", "shelf", None), (2, None, None, "shelf", "LookupError: no such shelf")]
    with pytest.raises(Exception, match="a DOI is a string"):
        spark.sql("SELECT * FROM {w} w, LATERAL shelf(w.work) r", w=works).collect()
    with pytest.raises(ValueError):
        template("ftp://x/{doi}")
