"""Work that once grew faster than the tables, or results that differed on larger ones."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F
from quire.functions import documents
from quire.operators import citations, claims, identity, segments
from quire.sources import records


def test_title_matches_by_rare_tokens_of_distinct_sets(spark):
    rng = random.Random(3)
    words = ["the", "of", "deep", "nets", "graphs", "causal", "trees", "for"]
    title = lambda: " ".join(["the", *rng.sample(words, rng.randint(0, 5))])
    asked = [(i, title()) for i in range(60)] + [(60, None), (61, "!?"), (62, "Über"), (63, "of of of")]
    held = [(i, title(), rng.choice([None, 0, 3, 7])) for i in range(200)] + [(200, "uber", 1), (201, None, 9), (202, "?", 9), (203, "OF", -2)]
    tokens = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    slug = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower().replace("ü", "u"))
    for threshold in (0.5, 0.85):
        want = {}
        for (i, a), (j, b, cites) in itertools.product(asked, held):
            f = 1.0 if slug(a) and slug(a) == slug(b) else 2 * len(tokens(a) & tokens(b)) / max(1, len(tokens(a)) + len(tokens(b)))
            if f >= threshold and f > 0:
                want[i] = min(want.get(i, (0, 0, 0)), (-f, -(cites or 0), j))
        rows = identity.best_title_matches(spark.createDataFrame(asked, "id long, title string"), spark.createDataFrame(held, "cand long, title string, citation_count long"), threshold=threshold).collect()
        assert {r["id"]: (round(r["similarity"], 9), r["cand"]) for r in rows} == {i: (round(-f, 9), j) for i, (f, _, j) in want.items()}
    # A word that all titles share brings no two of them together.
    sets = spark.createDataFrame([(["a", "b", "c", "the"],), (["d", "e", "f", "the"],)], "tokens array<string>")
    spread = spark.createDataFrame([("the", 9), ("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1)], "_t string, _df long")
    rare = [r["_t"] for r in identity._rarest_first(sets, spread, 0.85).collect()]
    assert sorted(rare) == ["a", "b", "d", "e"]


def test_a_number_on_the_line_before_a_reference_heading_stays():
    tail = "\n".join(f"[{i}] Lee et al. In Proceedings, 2001." for i in range(1, 7))
    for last in ("il", "Xi.", "12", "3."):
        text = f"{'Some words. ' * 20}\n{last}"
        assert documents.cut_references(f"{text}\nReferences\n{tail}") == text + documents.REFERENCES_CUT.rstrip()
        assert documents.cut_references(f"{text}\n\n {last} References:\n{tail}") == text + documents.REFERENCES_CUT.rstrip()


def test_atom_entries_are_parsed_once_and_whole(spark):
    entry = '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="urn:a"><id>http://arxiv.org/abs/2001.0000{}v2</id><title>{}</title><author><name>Ann\n Lee</name></author><author><name>Bo &lt;Li</name></author><published>1999-05-01</published><arxiv:doi>10.1000/X</arxiv:doi></entry>'
    payloads = [entry.format(0, "One &amp; <i>two</i>\n three"), "<feed>" + entry.format(1, "first</title><title>second") + entry.format(2, "other") + "</feed>", entry.format(3, "a &lt; b"), "<entry><title>broken</title", entry.format(4, " "), None]
    rows = records.from_arxiv(spark.createDataFrame([(str(i), x) for i, x in enumerate(payloads)], "work string, payload string"))
    got = {r["work"]: (r["title"], r["arxiv_id"], r["year"], r["doi"], r["authors"]) for r in rows.collect()}
    rest = (1999, "10.1000/x", ["Ann Lee", "Bo <Li"])
    assert got == {"0": ("One & two three", "2001.00000", *rest), "1": ("first", "2001.00001", *rest), "2": ("a < b", "2001.00003", *rest)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_match_cascade_joins_one_entry_for_an_identity(spark):
    entries = [(f"k{i}", "10.1/a", None, "One title", "verified" if i < 5 else "unread") for i in range(50)] + [("One-Title", None, "1.1", None, "unread")]
    items = [(1, "10.1/a", None, None, ""), (2, None, None, "one TITLE", "x"), (3, None, None, None, "onetitle"), (4, None, "1.1", None, ""), (5, None, None, None, "none")]
    e = spark.createDataFrame(entries, "key string, doi string, arxiv_id string, title string, status string")
    found = identity.match_cascade(spark.createDataFrame(items, "id long, doi string, arxiv_id string, title string, stem string"), e)
    assert {r["id"]: (r["key"], r["how"]) for r in found.collect()} == {1: ("k10", "unread by id"), 2: ("k10", "unread by title"), 3: ("One-Title", "file name"), 4: ("One-Title", "unread by id")}
    assert re.search(r"Aggregate \[kind#\d+, value#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())


def test_link_references_looks_a_work_up_once(spark, monkeypatch):
    asked, find = [], identity.find_duplicates
    monkeypatch.setattr(identity, "find_duplicates", lambda wanted, entries, **o: asked.append(wanted.count()) or find(wanted, entries, **o))
    ref = lambda t, d=None: (d, None, t, "old" if t == "nowhere" else None)
    rows = [("a", "Alpha", None, None, [ref("BETA!"), ref("nowhere"), ref("alpha"), ref("beta!", "10.1/c")]), ("b", "Beta", None, None, [ref("BETA!"), ref("nowhere")]), ("c", "Gamma", "10.1/C", None, [ref("BETA!")]), ("d", None, None, None, None)]
    e = spark.createDataFrame(rows, "key string, title string, doi string, arxiv_id string, references array<struct<doi: string, arxiv_id: string, title: string, key: string>>")
    got = {r["key"]: ([x["key"] for x in r["references"]] if r["references"] is not None else None, r["linked"]) for r in identity.link_references(e).collect()}
    assert got == {"a": (["b", "old", None, "b"], 2), "b": ([None, "old"], 0), "c": (["b"], 1), "d": (None, 0)}
    assert asked == [4]


def test_identities_fold_a_title_once(spark):
    rows = spark.createDataFrame([("Ünder " * 300,), ("." * 1500 + "Late",), ("", ), (None,), ("plain Title",)], "t string").select(identity.identities(F.lit(None).cast("string"), F.lit(""), F.col("t")).alias("i"))
    assert [[x["value"] for x in r["i"]] for r in rows.collect()] == [[("under" * 300)[:200]], ["late"], [], [], ["plaintitle"]]
    # Once for its start, and once for the whole of a long one.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2


def test_cocitation_pairs_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    rng = random.Random(8)
    links = [(o, rng.randint(0, 12)) for o in range(60) for _ in range(5)]
    both = [set(p for o, p in links if o == order) for order in range(60)]
    want = {(a, b): n for a, b in itertools.combinations(range(13), 2) if (n := sum({a, b} <= x for x in both)) >= 2}
    monkeypatch.setattr(citations, "PAIRS_A_TASK", 50, raising=False)
    pairs = citations.cocitation_pairs(spark.createDataFrame(links, "citing long, cited long"))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == want
    made = sum(len(x) * (len(x) - 1) // 2 for x in both)
    assert "RepartitionByExpression [a#" in re.sub(r"\s+", " ", plan := pairs._jdf.queryExecution().optimizedPlan().toString()) and f"], {-(-made // 50)}" in plan


def test_mined_references_make_their_links_once(spark, monkeypatch):
    kept, stage = [], citations.staged
    monkeypatch.setattr(citations, "staged", lambda df, tag: kept.append(tag) or stage(df, tag))
    ref = lambda t, y=None: (t, [], y, None, None)
    rows = [("a", "Alpha", [ref("New one", 3), ref("beta")]), ("b", "Beta", [ref("new-ONE", 4), ref("Rare")]), ("c", "Gamma", [ref("beta"), ref("New one"), ref("NEW one"), ref("")])]
    e = spark.createDataFrame(rows, "key string, title string, references array<struct<title: string, authors: array<string>, year: int, doi: string, arxiv_id: string>>").selectExpr("*", "CAST(NULL AS STRING) AS doi", "CAST(NULL AS STRING) AS arxiv_id")
    got = citations.mine_references(e).select("cited", "cocitations", "title", "year").collect()
    assert [tuple(r) for r in got] == [("newone", 3, "New one", 3)] and kept == ["cited-links", "cited-known"]


def test_claim_walks_broadcast_nothing_where_works_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(claims, "BROADCAST_ROWS", 2, raising=False)
    works = spark.createDataFrame([(n, 2000, True) for n in "abc"], "node string, year int, readable boolean")
    refs = spark.createDataFrame([("a", 0, "b", "b", None, None), ("b", 0, "c", "c", None, None)], "node string, index int, cited string, title string, doi string, arxiv_id string")
    walks = claims.ClaimWalks(spark, f"{tmp_path}/walks", works, refs)
    walks.begin(works.select(F.lit("c").alias("claim"), "node"))
    said = [("c", "a", True, False, False, [(0, 0.5)]), ("c", "b", True, False, False, [(0, 0.5)]), ("c", "c", True, True, False, None)]
    walks.advance(0, spark.createDataFrame(said, claims.SCHEMAS["answers"]))
    hops = walks.hops()
    assert sorted((r["start"], r["hop"], r["node"], r["status"]) for r in hops.collect()) == [("a", 1, "a", "origin"), ("a", 2, "b", "origin"), ("a", 3, "c", "origin"), ("b", 1, "b", "origin"), ("b", 2, "c", "origin"), ("c", 1, "c", "origin")]
    assert "Broadcast" not in hops._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_long_documents_hold_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_TOKENS", 300, raising=False)
    rng = random.Random(5)
    write = lambda most: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, most)))
    docs = {k: (write(4), write(90)) for k in range(80)} | {99: ("", "a " * 700), 98: ("", "")}
    index = segments.SegmentedIndex(spark, f"{tmp_path}/index", {"title": 3.0, "body": 0.1}, positions=True)
    m = index.apply(spark.createDataFrame([(k, *v) for k, v in docs.items()], "key long, title string, body string").repartition(2))
    words = {k: [x.split() for x in v] for k, v in docs.items()}
    ranges, seen = {}, set()
    for r in index._segment_blocks(m.segments[0]).collect():
        want = [(k, 3.0 * words[k][0].count(r["term"]) + 0.1 * words[k][1].count(r["term"]), sum(map(len, words[k]))) for k in r["keys"]]
        assert list(zip(r["keys"], r["f"], r["n"], strict=True)) == want and r["df"] == len(want)
        assert [[tuple(x) for x in p] for p in r["places"]] == [[(i, at) for i in (0, 1) for at, x in enumerate(words[k][i]) if x == r["term"]] for k in r["keys"]]
        best = {(f, n) for _, f, n in want if not any(g >= f and o <= n and (g, o) != (f, n) for _, g, o in want)}
        assert set(zip(r["top_f"], r["top_n"], strict=True)) == (best if len(want) > 1 else set()) and len(r["top_f"]) == (len(best) if len(want) > 1 else 0)
        ranges.setdefault(r["range"], set()).update(r["keys"])
        seen |= {(k, r["term"]) for k in r["keys"]}
    assert seen == {(k, x) for k, v in words.items() for f in v for x in f}
    assert all(len(keys) == 1 or sum(len(f) for k in keys for f in words[k]) <= 300 for keys in ranges.values()) and {99} in ranges.values()
    assert sum(map(len, ranges.values())) == len({k for k, _ in seen})
