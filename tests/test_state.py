"""What is kept between batches: claim walks, the request ledger and the batch log, also as streams that are killed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import claims
from quire.operators.claims import ClaimWalks
from quire.operators.ledger import Ledger, folded, outcomes, request_id, running_sum
from quire.sources.manifests import BatchLog, ManifestConflict

ANSWER = claims.SCHEMAS["answers"]
NAMES = "abcdefgxyz"


def world(spark):
    works = spark.createDataFrame([(n, f"Title {n}", 2000 + i if n != "z" else 0, n != "y", f"text of {n}") for i, n in enumerate(NAMES)], "node string, title string, year int, readable boolean, text string")
    cited = {"a": "bcdz", "b": "ef", "c": "", "d": "ag", "e": "xy", "f": "f"}
    refs = [(n, i, c if c != "x" else None, f"Title {c}", None, None) for n, cs in cited.items() for i, c in enumerate(cs)]
    return works, spark.createDataFrame(refs, "node string, index int, cited string, title string, doi string, arxiv_id string")


def reading(node, states=True, origin=False, failed=False, *blamed):
    return ("c", node, states, origin, failed, list(blamed))


def walk(walks):
    rows = walks.hops().orderBy("start", "hop").collect()
    return {s: ("".join(r["node"] for r in rows if r["start"] == s), [r["is_origin"] for r in rows if r["start"] == s][-1], next(r["status"] for r in rows if r["start"] == s)) for s in {r["start"] for r in rows}}


READINGS = [
    reading("a", True, False, False, (0, 0.4), (1, 0.9), (2, None), (3, 0.3), (99, 1.0)),  # of three: c, d, b; z is the fourth
    reading("b", True, False, False, (0, 0.8), (1, 0.2)),
    reading("c", False),
    reading("d", True, False, False, (0, 0.5), (1, 0.4)),
    reading("e", True, False, False, (0, 0.9), (1, 0.8)),
    reading("f", True, True),
    reading("g", None, None, True),
    reading("z", True, False, False),
]


def test_walks_wait_for_readings_and_go_on(spark, tmp_path):
    works, refs = world(spark)
    walks = ClaimWalks(spark, str(tmp_path), works, refs)
    starts = spark.createDataFrame([("c", n) for n in ("a", "b", "y", "g", "nowhere", "a")], "claim string, node string")
    walks.begin(starts)
    feed = lambda i, *nodes: walks.advance(i, spark.createDataFrame([r for r in READINGS if r[1] in nodes], ANSWER))
    assert {r["node"] for r in walks.pending().collect()} == {"a", "b", "y", "g", "nowhere"}
    assert feed(0, "a", "g") and walk(walks) == {"a": ("a", False, "walking"), "g": ("g", False, "failed"), "y": ("y", False, "unreadable")}
    assert {r["node"] for r in walks.pending().collect()} == {"b", "c", "d"}
    assert not feed(0, "b", "c", "d") and feed(1, "c", "d")
    assert {r["node"] for r in walks.pending().collect()} == {"b"}
    # Of b and d, which state it, b is older; of e and f, f is the origin.
    assert feed(2, "b", "e", "f") and walk(walks)["a"] == ("abf", True, "origin") and walk(walks)["b"] == ("bf", True, "origin")
    walks.begin(spark.createDataFrame([("c", "d"), ("c", "e"), ("c", "z"), ("c", "a")], "claim string, node string"))
    assert feed(3, "z") and walk(walks)["z"] == ("z", True, "unattributed") and walk(walks)["e"] == ("e", True, "unconfirmed")
    assert walk(walks)["d"] == ("dabf", True, "origin") and walks.pending().isEmpty()
    done = {r["start"]: r["status"] for r in walks.log.read("done").collect()}
    assert done["nowhere"] == "unresolved" and len(done) == 8
    chain = {r["start"]: r["chain"] for r in claims.chain_titles(walks.hops(), works).collect()}
    assert chain["a"] == "Title a (2000) -> Title b (2001) -> Title f (2005, original)" and chain["z"] == "Title z (n.d., original)"
    assert {r["node"] for r in claims.to_adopt(walks.hops(), works, spark.createDataFrame([("a",)], "node string")).collect()} == {"b", "d", "e", "f", "z"}


def test_loops_and_long_walks_stop(spark, tmp_path):
    works, _ = world(spark)
    refs = spark.createDataFrame([("a", 0, "b", "B", None, None), ("b", 0, "a", "A", None, None), ("c", 0, "d", "D", None, None), ("d", 0, "e", "E", None, None), ("e", 0, "f", "F", None, None)], "node string, index int, cited string, title string, doi string, arxiv_id string")
    walks = ClaimWalks(spark, str(tmp_path), works, refs, max_hops=3)
    walks.begin(spark.createDataFrame([("c", "a"), ("c", "c")], "claim string, node string"))
    walks.advance(0, spark.createDataFrame([reading(n, True, False, False, (0, None)) for n in "abcdef"], ANSWER))
    assert walk(walks) == {"a": ("ab", False, "looped"), "c": ("cde", False, "stopped")}


def test_a_stream_that_is_started_again_gives_the_same(spark, tmp_path):
    works, refs = world(spark)
    walks = ClaimWalks(spark, str(tmp_path / "walks"), works, refs)
    walks.begin(spark.createDataFrame([("c", "a")], "claim string, node string"))
    for i, nodes in enumerate(("ag", "bc", "def")):
        spark.createDataFrame([r for r in READINGS if r[1] in nodes], ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = walks.stream(spark.readStream.schema(ANSWER).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
    assert walk(walks) == {"a": ("abf", True, "origin")}
    # The last batch is forgotten by the stream, as after a crash before its commit: it comes again and changes nothing.
    last = max(os.listdir(tmp_path / "cp/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for name in (last, f".{last}.crc"):
        os.remove(tmp_path / "cp/commits" / name)
    before = walks.log.state()
    query = walks.stream(spark.readStream.schema(ANSWER).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert walks.log.state() == before


def test_what_is_asked_and_where_walks_start(spark):
    works, refs = world(spark)
    pending = spark.createDataFrame([("c", "a")], "claim string, node string")
    row = claims.request_texts(pending, spark.createDataFrame([("c", "Water is wet.")], "claim string, wording string"), works, refs).first()
    assert "claim: Water is wet." in row["request"] and row["request"].endswith("references:\n[0] Title b\n[1] Title c\n[2] Title d\n[3] Title z") and row["text"] == "text of a"
    hits = spark.createDataFrame([("c", "b", 2, True), ("c", "y", 1, True), ("c", "d", 1, False), ("d", "y", 1, True)], "claim string, node string, rank int, verified boolean")
    scouted = spark.createDataFrame([("d", "y", 0), ("d", "e", 1), ("e", "a", 3), ("c", "a", 0)], "claim string, node string, ord int")
    every = spark.createDataFrame([("c",), ("d",), ("e",)], "claim string")
    assert sorted(map(tuple, claims.found_starts(every, hits, works, scouted).collect())) == [("c", "b", "library"), ("d", "e", "scout")]


def plain(outcomes, retries=2):
    """The state after outcomes, by the rules one at a time."""
    state, kind, plain_call, tries, cost = "open", "full", False, 0, 0.0
    for seen, (n, what, price) in enumerate(outcomes):
        if n != seen or state != "open":
            break
        cost += price
        if what == "rejected" and not plain_call:
            plain_call = True
            continue
        tries += 1
        state = "done" if what == "usable" else "failed" if tries > retries else "open"
        kind = ("again" if what == "blank" or kind == "repair" else "repair") if what in ("unusable", "blank") else "full"
    return state, kind, plain_call, tries, cost


def test_states_follow_the_rules(spark):
    import itertools

    kinds = ["usable", "unusable", "blank", "error", "rejected"]
    rows = [(i, [(n, o, 1.0) for n, o in enumerate(os)]) for i, os in enumerate(itertools.chain.from_iterable(itertools.product(kinds, repeat=k) for k in range(5)))]
    rows.append((9999, [(0, "error", 1.0), (2, "usable", 1.0)]))
    df = spark.createDataFrame(rows, "i int, a array<struct<attempt:int,outcome:string,cost:double>>").select("i", "a", folded(F.col("a")).alias("s"))
    for r in df.collect():
        want = plain([tuple(x) for x in r["a"]])
        got = (r["s"]["state"], r["s"]["kind"], r["s"]["plain"], r["s"]["tries"], r["s"]["cost"])
        assert got == want or want[0] != "open" and (got[0], *got[2:]) == (want[0], *want[2:]), (r["a"], got, want)


def test_ledger_batches_count_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    asked = spark.createDataFrame([("origin", "high", "p", "t"), ("origin", "low", "p", "t"), ("origin", "high", "pt", None)], "role string, effort string, prompt string, text string")
    assert ledger.apply(0, asked) and not ledger.apply(0, asked) and ledger.states().count() == 2
    ids = {r["prompt"]: r["id"] for r in asked.select("prompt", request_id(F.col("role"), F.col("prompt"), F.col("text")).alias("id")).collect()}
    replies = spark.createDataFrame(
        [(ids["p"], 1, "origin", '```json\n{"is_origin": true}\n```', None, "m", 2.0), (ids["p"], 0, "origin", '{"other": 1}', None, "m", 1.0), (ids["pt"], 0, "origin", "", "Unknown option --effort", "n", None), (None, 0, "origin", "{}", None, "m", 9.0)],
        "id string, attempt int, role string, reply string, error string, model string, cost double",
    )
    assert sorted((r["outcome"] for r in outcomes(replies).collect())) == ["rejected", "unusable", "unusable", "usable"]
    assert ledger.apply(1, asked, outcomes(replies)) and ledger.apply(2, attempts=outcomes(replies.withColumn("cost", F.lit(7.0))))
    got = {r["id"]: r for r in ledger.states().collect()}
    assert (got[ids["p"]]["state"], got[ids["p"]]["cost"], got[ids["p"]]["next_attempt"]) == ("done", 3.0, 2)
    assert (got[ids["pt"]]["state"], got[ids["pt"]]["effort"], got[ids["pt"]]["tries"]) == ("open", None, 0)
    assert [r["allowed"] for r in ledger.due(5.0, 2.0).collect()] == [True] and [r["allowed"] for r in ledger.due(4.9, 2.0).collect()] == [False]
    assert {r["model"]: (r["calls"], r["cost"]) for r in ledger.usage().collect()} == {"m": (2, 3.0), "n": (1, None)}


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1.0).alias("v")).repartition(7)
    got = running_sum(rows, "v", ["k"]).collect()
    assert sorted((r["k"], r["running"]) for r in got) == [(k, k + 1.0) for k in range(1000)] and running_sum(rows.limit(0), "v", ["k"]).collect() == []


def test_batch_log_refuses_a_second_writer_and_joins_parts(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path), {"t": "a int, b array<struct<x:int,y:int>>"})
    row = lambda a: spark.createDataFrame([(a, [(1, 2)])], "a int, b array<struct<x:int,y:int>>")
    monkeypatch.setattr(BatchLog, "MOST_PARTS", 2)
    for i in range(4):
        log.commit(i, {"t": row(i)})
    assert sorted(r["a"] for r in log.read("t").collect()) == [0, 1, 2, 3] and len(log.state()[1]["parts"]["t"]) == 2
    stale = log.state()
    log.commit(4, {}, {"t": row(9)})
    assert [r["a"] for r in log.read("t").collect()] == [9]
    monkeypatch.setattr(log, "state", lambda: stale)
    with pytest.raises(ManifestConflict):
        log.commit(4, {"t": row(5)})
