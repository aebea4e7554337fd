"""Operators on small libraries."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import actions, citations, export, identity, maintain, quality, ranking
from quire.operators import search as searching
from quire.plans import planning, providers
from quire.schema import ENTRY, RECORD
from quire.sources import records


def entry(spark, *rows):
    names = [f.split()[0] for f in ENTRY.split(", ") if " " in f.strip() and not f.startswith(("summary", "doi:"))]
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(ENTRY)
    full = [{f.name: r.get(f.name, [] if f.dataType.typeName() == "array" else None) for f in schema} for r in rows]
    assert names
    return spark.createDataFrame(full, schema)


@pytest.fixture
def stocked(spark):
    ref = {"title": "Attention Is All You Need", "year": 2017, "doi": None, "arxiv_id": "1706.03762", "authors": ["A V"], "key": None}
    other = {"title": "Unseen Work", "year": 2015, "doi": "10.1/u", "arxiv_id": None, "authors": [], "key": None}
    return entry(
        spark,
        {"key": "a2017", "title": "Attention Is All You Need", "arxiv_id": "1706.03762", "year": 2017, "level": "A*", "status": "verified", "tags": ["transformers"], "type": "conference paper", "authors": ["Ashish Vaswani", "N S"], "venue": "NeurIPS", "references": [other, other], "one_liner": "self attention", "citation_count": 9},
        {"key": "b2020", "title": "Language Models are Few-Shot Learners", "year": 2020, "level": "A*", "status": "verified", "tags": ["LLM"], "type": "conference paper", "authors": ["Tom Brown"], "venue": "NeurIPS", "references": [ref, other], "notes": "mine"},
        {"key": "c2010", "title": "An old survey", "year": 2010, "level": "C", "status": "UNVERIFIED", "tags": [], "type": "journal article", "authors": ["Q"], "venue": "Elsevier BV", "references": [other]},
    )


def test_search_matches_the_formula_of_fts5(spark):
    docs = [("k1", "deep learning of deep nets", "apple"), ("k2", "learning to rank", "deep pear pear"), ("k3", "graphs", "orange"), ("k4", "more graphs", "plum"), ("k5", "trees", "fig")]
    df = spark.createDataFrame(docs, "key string, title string, body string")
    got = {r["key"]: r["score"] for r in searching.Index.build(df, {"title": 8.0, "body": 2.0}).scores(["deep", "learning"]).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(key unindexed, title, body, tokenize='unicode61')")
    con.executemany("insert into t values (?, ?, ?)", docs)
    want = dict(con.execute("select key, bm25(t, 0, 8.0, 2.0) from t where t match '\"deep\" OR \"learning\"'").fetchall())
    assert got == pytest.approx(want)


def test_phrases(spark):
    df = spark.createDataFrame([("a", "state space models"), ("b", "space of state models"), ("c", "none"), ("d", "x y"), ("e", "z")], "key string, title string")
    index = searching.Index.build(df, {"title": 1.0}, positions=True)
    assert [r["key"] for r in index.scores([], [["state", "space"]], [1.0]).collect()] == ["a"]


def test_query_rewrite(spark):
    q = 'What are "causal discovery" methods in few-shot C++ few-shot?'
    want = '"causal discovery" OR "methods" OR "few-shot" OR "C++"'
    assert searching.match_expression(q) == want
    assert spark.createDataFrame([(q,)], "q string").select(searching.match_column(F.col("q"))).first()[0] == want


def test_filters_and_listing(spark, stocked):
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(searching.search(stocked, "")) == ["b2020", "a2017", "c2010"]
    assert keys(searching.search(stocked, "attention")) == ["a2017"] and keys(searching.search(stocked, "attention", year_from=2018)) == []
    assert keys(searching.search(stocked, 'the "Few-Shot Learners"')) == ["b2020"]
    assert keys(searching.matching(stocked, tag="llm")) == ["b2020"] and keys(searching.backlog(stocked)) == ["c2010"]
    assert keys(searching.listed(stocked, sort="title", limit=1)) == ["c2010"]


def test_identity(spark, stocked):
    linked = {r["key"]: r for r in identity.link_references(stocked).collect()}
    assert linked["b2020"]["linked"] == 1 and linked["b2020"]["references"][0]["key"] == "a2017" and linked["c2010"]["linked"] == 0
    wanted = spark.createDataFrame([(1, None, None, "attention is ALL you need!"), (2, "10.9/x", None, "other"), (3, None, "1706.03762", "no")], "id int, doi string, arxiv_id string, title string")
    assert {r["id"]: r["key"] for r in identity.find_duplicates(wanted, stocked).collect()} == {1: "a2017", 3: "a2017"}
    taken = spark.createDataFrame([("k",), ("ka",)], "key string")
    new = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "id int, base string")
    assert {r["id"]: r["key"] for r in identity.unique_keys(new, taken).collect()} == {1: "kb", 2: "kc", 3: "z"}
    q = spark.createDataFrame([(1, "Deep residual learning"), (2, "nothing like it")], "id int, title string")
    c = spark.createDataFrame([(10, "Deep Residual Learning", 10), (11, "deep residual learning", 6597), (12, "residual", 1)], "cand int, title string, citation_count int")
    assert [(r["id"], r["cand"], r["similarity"]) for r in identity.best_title_matches(q, c).collect()] == [(1, 11, 1.0)]


def test_citations(spark, stocked):
    mined = citations.mine_references(stocked).collect()
    assert [(r["cited"], r["cocitations"]) for r in mined] == [("10.1/u", 3)]
    links = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("c", "a", 1), ("c", "d", 5)], "citing string, cited string, y int")
    walk = citations.chains(spark.createDataFrame([("a",)], "node string"), links, [F.col("y")]).orderBy("hop").collect()
    assert [r["node"] for r in walk] == ["a", "c", "d"]


def test_levels(spark):
    rows = [("NeurIPS", "conference paper", 2017, 10), ("AISTATS", "conference paper", 2000, 9000), ("NeurIPS Workshop", "workshop paper", 2020, 800), ("X", "preprint", 2020, 1500), (None, "preprint", 2025, 3), ("X", "journal article", 2000, 10), ("X", "journal article", 2000, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, venue string, type string, year int, cites int")
    v = quality.assessed(F.col("venue"), F.col("type"), F.col("year"), F.col("cites"), 2026)
    got = [(r["v"]["level"], r["v"]["needs_judgement"]) for r in df.select("i", v.alias("v")).orderBy("i").collect()]
    assert got == [("A*", False), ("A*", False), ("A", False), ("A*", False), ("unranked", True), ("C", True), ("unranked", True)]


def test_pool(spark):
    rows = [(i, 3, ["x"], 2000 + i % 5) for i in range(40)] + [(100 + i, 0, ["x"], 2020) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, cocitations int, angles array<string>, year int")
    order = [*ranking.triage(F.size("angles"), F.col("cocitations"), F.col("year")), F.col("id")]
    kept = [r["id"] for r in ranking.trimmed(df, 20, strong=ranking.corroborated(F.col("cocitations"), F.size("angles")), order=order).collect()]
    assert len(kept) == 20 and sum(i >= 100 for i in kept) == 6
    lists = spark.createDataFrame([("a", 1, "shared"), ("a", 2, "only a"), ("b", 1, "shared"), ("b", 2, "only b"), ("b", 3, "")], "source string, place int, who string")
    assert [r["who"] for r in ranking.interleaved(lists).orderBy("position").collect()] == ["shared", "only a", "only b"]


def test_maintenance(spark, stocked):
    found = {(r["key"], r["field"]) for r in maintain.audit(stocked, 2026).collect()}
    assert found == {("b2020", "citation_count"), ("c2010", "venue"), ("c2010", "citation_count")}
    fresh = stocked.withColumns({"citation_count": F.lit(50).cast("bigint"), "venue": F.lit("ICML"), "abstract": F.lit("now")})
    diff = {r["key"]: r["changes"] for r in maintain.refreshed(stocked, fresh).collect()}
    assert diff["a2017"] == ["citations 9 -> 50", "abstract"] and "venue Elsevier BV -> ICML" in diff["c2010"]
    theirs = stocked.withColumns({"notes": F.lit("theirs"), "updated": F.lit("2030-01-01"), "status": F.lit("unread")}).withColumn("key", F.when(F.col("key") == "c2010", "../evil").otherwise(F.col("key")))
    out = {r["incoming"]: (r["outcome"], r["notes"]) for r in maintain.imported(stocked, theirs).collect()}
    assert out["../evil"][0] == "skipped" and out["a2017"][0] == "skipped" and out["b2020"][1].startswith("mine\n\n")
    replaced = {r["incoming"]: r["outcome"] for r in maintain.imported(stocked, theirs, strategy="replace").collect()}
    assert replaced["a2017"] == "updated"
    merged = maintain.saved(stocked, stocked.withColumn("notes", F.lit("lost"))).where("key = 'b2020'").first()
    assert merged["notes"] == "mine"


def test_export(spark, stocked):
    text = [r["text"] for r in export.cited(stocked).collect()]
    assert [t.split("{")[1].split(",")[0] for t in text] == ["b2020", "c2010", "a2017"] and "booktitle = {NeurIPS}" in text[0] and "archivePrefix = {arXiv}" in text[2]
    cards = {r["key"]: r["card"] for r in export.card(stocked).collect()}
    assert cards["b2020"].startswith("[b2020] Language Models") and max(map(len, cards.values())) < 3000


def test_records(spark):
    crossref = '{"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"name": "Group"}], "DOI": "10.1000/X", "type": "journal-article", "publisher": "Elsevier BV", "issued": {"date-parts": [[2001, 2]]}, "is-referenced-by-count": 5, "abstract": "&lt;p&gt;Hi&lt;/p&gt;", "reference": [{"unstructured": "R1", "year": "1999a"}, {"year": "2000"}]}}'
    s2 = '{"title": "T ", "authors": [{"name": "A B"}], "year": 2001, "venue": "NeurIPS", "citationCount": 9, "externalIds": {"ArXiv": "1706.03762", "DOI": "10.1000/x"}, "publicationTypes": ["Conference"], "references": []}'
    a = records.from_crossref(spark.createDataFrame([("w", crossref)], "work string, payload string"))
    b = records.from_semantic_scholar(spark.createDataFrame([("w", s2)], "work string, payload string"))
    x = a.first()
    assert x["authors"] == ["A B", "Group"] and x["venue"] is None and x["year"] == 2001 and x["abstract"] == "Hi" and x["references"][0]["year"] == 1999 and len(x["references"]) == 1
    m = maintain.merged_records(a.unionByName(b)).first()
    assert m["venue"] == "NeurIPS" and m["citation_count"] == 9 and m["arxiv_id"] == "1706.03762" and m["doi"] == "10.1000/x" and m["type"] == "journal article" and m["sources"] == ["crossref", "semanticscholar"]
    atom = '<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/1706.03762v1</id><title>Attention\n Is</title><published>2017-06-12T00:00:00Z</published><author><name>A V</name></author></entry>'
    y = records.from_arxiv(spark.createDataFrame([("w", atom)], "work string, payload string")).first()
    assert (y["title"], y["year"], y["authors"], y["arxiv_id"]) == ("Attention Is", 2017, ["A V"], "1706.03762")
    assert set(RECORD.split()) and records.supplementary(b.withColumn("title_matched", F.lit(True))).first()["doi"] is None


def test_planning():
    plan = planning.read_plan("q", {"queries": ["a  b c", "A B C", "x"], "year_from": "2020", "year_to": 2010, "kind": "surveys", "tags": ["Deep Learning"]}, 2026)
    assert plan.queries == ("a b c",) and (plan.year_from, plan.year_to, plan.kind, plan.tags) == (2010, 2020, "review", ("deep-learning",))
    assert planning.extract_json('say ```json\n{"a": 1}\n```') == {"a": 1} and planning.extract_json("so {x} {\"b\": {\"c\": 2}} end") == {"b": {"c": 2}} and planning.extract_json("[1]") == {"items": [1]}
    assert planning.selection("1,3-4", 5) == [0, 2, 3] and planning.selection("x", 5) is None and planning.selection("all", 2) == [0, 1]


def test_actions(spark, stocked):
    found = actions.as_candidates(records.from_semantic_scholar(spark.createDataFrame([("w", '{"title": "A new paper on attention", "year": 2024, "citationCount": 300, "externalIds": {"DOI": "10.5555/n"}}')], "work string, payload string")), "relevance", "search")
    pool = actions.discover(stocked, found, planning.unplanned("attention"), 2026).collect()
    assert {r["dedup_key"] for r in pool} == {"10.1/u", "10.5555/n"}
    text = "We show that attention is enough. " * 200
    full = spark.createDataFrame([("a2017", text, None)], "doc string, text string, pages_read int")
    said = providers.Tables(evidence=spark.createDataFrame([("a2017", True, "yes", ["attention is ENOUGH", "never said"])], "key string, relevant boolean, summary string, quotes array<string>"))
    got = actions.ask(stocked, "attention", full, said).first()
    assert got["quotes"] == ["attention is ENOUGH"] and got["outcome"] == "cited"
    inbox = spark.createDataFrame([("f1", "x", "Preprint\narXiv:1706.03762v5\nAttention Is All You Need\n")], "id string, stem string, text string")
    assert actions.drain_inbox(inbox, stocked).first()["how"] == "any by id"
    links = spark.createDataFrame([("a2017", "github.com/a/b", True, "exists"), ("b2020", "github.com/a", True, "exists")], "key string, url string, official boolean, reachable string")
    assert {r["key"]: r["status"] for r in actions.find_code(stocked, links).collect()} == {"a2017": "found", "b2020": "rejected", "c2010": "none"}
    each = providers.asked_each(stocked.select("key"), lambda r: {"n": 1 // (r["key"] != "b2020")}, "n int").collect()
    assert {r["key"]: bool(r["error"]) for r in each} == {"a2017": False, "b2020": True, "c2010": False}
    assert {r["key"]: r["status"] for r in actions.check_entries(stocked, stocked.limit(0), 2026).collect()} == {"a2017": "clean", "b2020": "unresolved", "c2010": "unresolved"}


def test_add(spark, stocked):
    s2 = '{"title": "Brand new method", "authors": [{"name": "Zoe Lin"}], "year": 2019, "venue": "ICML", "citationCount": 90, "externalIds": {"DOI": "10.5555/n"}, "publicationTypes": ["Conference"]}'
    old = '{"title": "attention is all you need", "year": 2017}'
    low = '{"title": "Weak paper", "year": 2001, "citationCount": 1, "publicationTypes": ["Conference"], "venue": "PLOS ONE"}'
    raw = spark.createDataFrame([("n", s2), ("o", old), ("l", low)], "work string, payload string")
    full = spark.createDataFrame([("n", "body of it, code at github.com/zoe/new " * 200, None, None)], "doc string, text string, pages int, pages_read int")
    reader = providers.Tables(reader=spark.createDataFrame([("n", "It works", [("", "one")], ["f"], ["Deep Nets"], "https://github.com/zoe/new")], "work string, one_liner string, sections array<struct<name:string,summary:string>>, key_findings array<string>, tags array<string>, code_url string"))
    out = {r["work"]: r for r in actions.add_papers(stocked, maintain.merged_records(records.from_semantic_scholar(raw)), full, 2026, min_level="A", provider=reader).collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {"n": "added", "o": "duplicate", "l": "rejected"}
    assert out["n"]["key"] == "lin2019brand" and out["n"]["status"] == "verified" and out["n"]["code_url"] == "https://github.com/zoe/new" and out["n"]["tags"] == ["deep-nets"]
