"""Commands over a library and a folder of answers."""

from __future__ import annotations

import json
import shutil

import pytest

from quire import cli
from quire.library import Library
from tests.test_operators import stocked  # noqa: F401

LONG = "We show that attention is enough, see github.com/zoe/new for code. " * 100


@pytest.fixture
def run(spark, stocked, tmp_path, capsys):  # noqa: F811
    Library.create(spark, str(tmp_path), "one").save(stocked)
    answers = tmp_path / "answers"
    answers.mkdir()

    def call(*arguments, **tables):
        for name, rows in tables.items():
            (answers / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
        code = cli.main(["--root", str(tmp_path), "--json", "--tables", str(answers), *arguments])
        out = capsys.readouterr()
        return code, [json.loads(x) for x in out.out.splitlines() if x.startswith("{")], out.err

    call.library = Library(spark, f"{tmp_path}/one")
    return call


def test_find_add_and_read(run):
    record = {"work": "n", "priority": 1, "title": "Brand new method", "authors": ["Zoe Lin"], "year": 2019, "venue": "ICML", "type": "conference paper", "doi": "10.5555/n", "citation_count": 90, "source": "x", "title_matched": False, "references": []}
    old = record | {"work": "o", "title": "attention is all you need", "doi": None}
    found = run("find", "method", records=[record, old], rank=[{"dedup_key": "10.5555/n", "score": 0.9}])[1]
    assert [r["dedup_key"] for r in found] == ["10.5555/n", "10.1/u"] and found[0]["relevance"] == 0.9
    reader = [{"key": "n", "one_liner": "It works", "sections": [{"name": "", "summary": "one"}], "key_findings": ["f"], "tags": ["Deep Nets"], "code_url": "https://github.com/zoe/new"}]
    done = {r["work"]: r for r in run("add", fulltexts=[{"doc": "n", "text": LONG}, {"doc": "c2010", "text": LONG}], reader=reader)[1]}
    assert done["n"]["outcome"] == "added" and done["o"]["outcome"] == "duplicate" and len(run.library) == 4
    added = run.library.get(done["n"]["key"]).first()
    assert added["status"] == "verified" and added["code_url"] == "https://github.com/zoe/new" and added["tags"] == ["deep-nets"] and added["added"]
    # Known works are drafted anew when asked for, and keep their reading and dates; other libraries are named.
    other = Library.create(run.library.spark, run.library.folder.rsplit("/", 1)[0], "two")
    other.save(run.library.get(done["n"]["key"]).drop("path", "mtime"))
    again = {r["work"]: r for r in run("-L", "one", "add", "--refresh", records=[record | {"citation_count": 95}, old | {"citation_count": 12}], reader=[])[1]}
    assert again["n"]["outcome"] == "updated" and again["n"]["elsewhere"] == f"two/{done['n']['key']}" and again["n"]["key"] == done["n"]["key"]
    fresh = run.library.get(done["n"]["key"]).first()
    assert (fresh["citation_count"], fresh["one_liner"], fresh["status"], fresh["code_url"]) == (95, "It works", "verified", "https://github.com/zoe/new") and len(run.library) == 4
    shutil.rmtree(other.folder.removeprefix("file://"))
    # Without an answer nothing changes; a reading that is there is only replaced when asked for.
    assert run("read", reader=[{"key": "a2017", "one_liner": "other"}])[1] == [{"key": "c2010", "status": "no answer"}]
    assert run("read", reader=[{"key": "c2010", "one_liner": "old but good", "sections": []}])[1][0]["status"] == "verified"
    run("reread", "a2017", reader=[{"key": "a2017", "one_liner": "other", "sections": []}])
    assert run.library.get("a2017").first()["one_liner"] == "other" and run.library.get("b2020").first()["notes"] == "mine"


def test_refresh_check_and_code(run):
    assert run("refresh")[1] == [] and run("refresh", fresh=[{"key": "a2017", "citation_count": 11, "references": []}])[1] == [{"key": "a2017", "changes": "citations 9 -> 11"}]
    assert run.library.get("a2017").first()["citation_count"] == 11
    status = lambda *a, **t: {r["key"]: r["status"] for r in run("check", *a, **t)[1]}
    fix = [{"key": "c2010", "field": "venue", "proposed": "ICML", "source": "index"}, {"key": "b2020", "field": "year", "proposed": "9999", "source": "index"}]
    assert status(check=fix) == {"a2017": "clean", "b2020": "unresolved", "c2010": "proposed"} and run.library.get("c2010").first()["venue"] == "Elsevier BV"
    assert status("--fix")["c2010"] == "fixed" and run.library.get("c2010").first()["venue"] == "ICML"
    links = [{"key": "a2017", "url": "github.com/a/b", "official": True, "reachable": "exists"}, {"key": "b2020", "url": "github.com/a", "official": True, "reachable": "exists"}]
    assert {r["key"]: r["status"] for r in run("code", links=links)[1]} == {"a2017": "found", "b2020": "rejected", "c2010": "none"}
    assert run.library.get("a2017").first()["code_url"] == "https://github.com/a/b" and run.library.get("b2020").first()["code_url"] is None
    assert run.library.get("a2017").first()["code_reason"] == "author release"


def test_inbox_ask_claim_and_settings(run):
    assert run("inbox", files=[{"id": "f", "stem": "x", "text": "arXiv:1706.03762v5\nAttention Is All You Need\n"}])[1][0]["key"] == "a2017"
    evidence = [{"key": "a2017", "relevant": True, "summary": "yes", "quotes": ["attention is ENOUGH"]}]
    told = run("ask", "attention", fulltexts=[{"doc": "a2017", "text": LONG}], evidence=evidence)[1][0]["markdown"]
    assert "- yes [a2017]" in told and "Attention Is All You Need" in told.split("## Sources")[1]
    step = {"citing": "b2020", "cited": "a2017", "ord": 1, "confidence": 0.9, "states_claim": True, "is_origin": True, "readable": True, "year": 2017, "title": "Attention"}
    walk = run("claim", "b2020", verdicts=[step])[1]
    assert [(r["hop"], r["node"], r["is_origin"]) for r in walk] == [(0, "b2020", False), (1, "a2017", True)]
    assert run("use", "nope")[0] == 1 and run("use", "one")[0] == 0
    assert run("config", "min_level", "A")[1] == [{"min_level": "A"}] and run("config")[1][0]["min_level"] == "A" and run("config", "auto_approve", "maybe")[0] == 1
