"""Queries of what is kept between batches: walks after claims and a ledger of requests, beside the SQL of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.claims import ClaimWalks, chain_titles
from quire.operators.ledger import Ledger, outcomes, request_id
from quire.plans.tables import query
from quire.plans.tables import table as _t
from quire.sources.storage import fresh_path

MAX_HOPS = 5
#: What a reading says of a part, by its size and price: never answered, failed, states the claim, is its origin.
NEVER, FAILED, STATES, ORIGIN, UNREADABLE = "p_size % 17 = 3", "p_size % 19 = 4", "p_size % 4 <> 1", "CAST(p_retailprice * 10 AS BIGINT) % 11 = 0", "p_brand = 'Brand#13'"

_CLAIMS = f"""
WITH RECURSIVE e AS (SELECT citing, cited, conf, row_number() OVER (PARTITION BY citing ORDER BY d, cited) - 1 AS i FROM (
  SELECT l_partkey AS citing, (l_partkey * 7 + l_suppkey * 13) % 2000 AS cited, min(l_shipdate) AS d, max(l_discount) AS conf FROM lineitem GROUP BY 1, 2)),
p AS (SELECT p_partkey AS node, p_name || ' ' || p_partkey AS title, nullif(1990 + p_size % 13, 1990) AS year, NOT ({UNREADABLE}) AS readable, NOT ({NEVER}) AS answered, {FAILED} AS failed, {STATES} AS states, {ORIGIN} AS origin FROM part),
k AS (SELECT citing, cited, row_number() OVER (PARTITION BY citing ORDER BY conf DESC, i) AS place FROM e QUALIFY place <= 3),
f AS (SELECT citing, count(*) FILTER (readable AND NOT answered) AS waiting, arg_min(cited, (NOT origin, coalesce(year, 9999), place)) FILTER (readable AND answered AND NOT failed AND states) AS best FROM k LEFT JOIN p ON cited = node GROUP BY citing),
s AS (SELECT p.*, waiting, best, f.citing IS NOT NULL AS blames FROM p LEFT JOIN f ON node = citing),
w AS (SELECT node AS start, 0 AS hop, node, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS VARCHAR) AS status, false AS made, false AS stated, false AS is_origin FROM p
UNION ALL SELECT start, hop + made2, CASE WHEN ended IS NULL THEN best ELSE node END, list_append(seen, node), ended, made2 = 1, made2 = 1 AND readable AND NOT failed AND states, coalesce(made2 = 1 AND ended IN ('origin', 'unattributed', 'unconfirmed'), false) FROM (
  SELECT w.start, w.hop, w.node, w.seen, s.readable, s.states, s.failed, s.best, CAST(CASE WHEN hop >= {MAX_HOPS} OR list_contains(seen, w.node) OR (readable AND NOT answered) THEN 0 ELSE 1 END AS INTEGER) AS made2,
    CASE WHEN hop >= {MAX_HOPS} THEN 'stopped' WHEN list_contains(seen, w.node) THEN 'looped' WHEN NOT readable THEN 'unreadable' WHEN NOT answered THEN 'walking' WHEN failed THEN 'failed' WHEN origin THEN 'origin'
      WHEN NOT blames THEN 'unattributed' WHEN waiting > 0 THEN 'walking' WHEN best IS NULL THEN 'unconfirmed' END AS ended
  FROM w JOIN s ON s.node = w.node WHERE w.status IS NULL)),
h AS (SELECT start, hop, seen[-1] AS node, made, stated, is_origin, status FROM w WHERE len(seen) > 0),
z AS (SELECT start, max(status) AS status, count(*) FILTER (made) AS hops, string_agg(title || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || CASE WHEN is_origin THEN ', original' ELSE '' END || ')', ' -> ' ORDER BY hop) FILTER (made) AS chain FROM h JOIN p ON h.node = p.node GROUP BY start)
SELECT start, status, hops, chain FROM z
"""


@query(_CLAIMS)
def claim_walks(spark, sf_dir):
    """Walks from every part along what readings blame, whose answers come in three batches; one is applied twice, some answers never come."""
    parts = _t(spark, sf_dir, "part").withColumns({"node": F.col("p_partkey").cast("string"), "claim": F.lit("c")})
    works = parts.select("node", F.concat("p_name", F.lit(" "), "node").alias("title"), F.nullif(1990 + F.col("p_size") % 13, F.lit(1990)).alias("year"), F.expr(f"NOT ({UNREADABLE})").alias("readable"))
    cited = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 2000).alias("cited")
    edges = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("citing"), cited).agg(F.min("l_shipdate").alias("d"), F.max("l_discount").alias("confidence"))
    listed = edges.groupBy("citing").agg(F.array_sort(F.collect_list(F.struct("d", "cited", "confidence"))).alias("r"))
    none = F.lit(None).cast("string")
    refs = listed.select(F.col("citing").cast("string").alias("node"), F.posexplode("r").alias("index", "x")).select("node", "index", F.col("x.cited").cast("string").alias("cited"), F.concat(F.lit("work "), F.col("x.cited").cast("string")).alias("title"), none.alias("doi"), none.alias("arxiv_id"))
    blamed = listed.select(F.col("citing").cast("string").alias("node"), F.transform("r", lambda x, i: F.struct(i.alias("index"), x["confidence"].alias("confidence"))).alias("attributed"))
    answers = parts.where(f"NOT ({NEVER})").select("claim", "node", "p_partkey", F.expr(STATES).alias("states_claim"), F.expr(ORIGIN).alias("is_origin"), F.expr(FAILED).alias("failed")).join(blamed, "node", "left")
    walks = ClaimWalks(spark, fresh_path(spark, "walks"), works, refs, max_hops=MAX_HOPS)
    walks.begin(parts.select("claim", "node"))
    late = F.col("p_partkey") % 3
    walks.advance(0, answers.where(late == 0))
    walks.advance(1, answers.where(late == 1))
    walks.advance(1, answers.where(late == 2))  # a batch of this number was applied: nothing changes
    # What was answered before comes again, otherwise: it does not count.
    walks.advance(2, answers.withColumn("failed", F.when(late == 2, F.col("failed")).otherwise(~F.col("failed"))))
    hops, ends = walks.hops(), walks.log.read("done")
    chains = chain_titles(hops, works)
    counts = hops.groupBy("start").agg(F.count("*").alias("hops"))
    rows = parts.select(F.col("node").alias("start")).join(ends.select("start", "status"), "start", "left").join(counts, "start", "left").join(chains.select("start", "chain"), "start", "left")
    return rows.select(F.col("start").cast("long").alias("start"), F.coalesce("status", F.lit("walking")).alias("status"), F.coalesce("hops", F.lit(0).cast("long")).alias("hops"), "chain")


BUDGET, ESTIMATE, RETRIES = 100_000.0, 150.0, 2

_LEDGER = f"""
WITH RECURSIVE q AS (SELECT DISTINCT user_id FROM events),
a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'rejected' ELSE 'error' END WHEN 'signup' THEN 'blank' WHEN 'click' THEN 'unusable' WHEN 'view' THEN CASE WHEN CAST(props->>'k' AS INTEGER) % 2 = 0 THEN 'usable' ELSE 'unusable' END ELSE 'unusable' END AS what FROM events),
s AS (SELECT user_id, 'open' AS state, 'full' AS kind, false AS plain, 0 AS tries, CAST(0 AS BIGINT) AS seen, 0.0::DOUBLE AS cost FROM q
UNION ALL SELECT user_id, CASE WHEN what = 'usable' THEN 'done' WHEN t > {RETRIES} THEN 'failed' ELSE 'open' END,
  CASE WHEN what = 'unusable' AND kind <> 'repair' THEN 'repair' WHEN what IN ('unusable', 'blank') THEN 'again' WHEN free THEN kind ELSE 'full' END, plain OR free, t, seen + 1, cost + value FROM (
  SELECT s.*, what, value, what = 'rejected' AND NOT plain AS free, tries + CASE WHEN what = 'rejected' AND NOT plain THEN 0 ELSE 1 END AS t FROM s JOIN a ON s.user_id = a.user_id AND s.seen = a.n WHERE state = 'open')),
z AS (SELECT user_id, sha256('4:plan' || length('user ' || user_id) || ':user ' || user_id || '0:') AS id, arg_max(state, seen) AS state, arg_max(kind, seen) AS kind, arg_max(plain, seen) AS plain, arg_max(tries, seen) AS tries, max(seen) AS next_attempt, arg_max(cost, seen) AS cost FROM s GROUP BY user_id),
o AS (SELECT *, sum(CASE WHEN state = 'open' THEN {ESTIMATE} END) OVER (PARTITION BY state ORDER BY user_id % 2, id) <= {BUDGET} - (SELECT sum(cost) FROM z) AS allowed FROM z)
SELECT id, state, kind, CASE WHEN plain THEN NULL WHEN kind = 'repair' THEN 'low' ELSE 'high' END AS effort, tries, CAST(next_attempt AS INTEGER) AS next_attempt, round(cost, 4) AS cost, CASE WHEN state = 'open' THEN allowed END AS allowed FROM o
"""


@query(_LEDGER)
def request_ledger(spark, sf_dir):
    """A request of each user, whose events are its attempts in the order of time; batches come out of order, and one twice."""
    events = _t(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    requests = events.select("user_id").distinct().select("user_id", F.lit("plan").alias("role"), F.lit("high").alias("effort"), user.alias("prompt"), F.lit(None).cast("string").alias("text"))
    kind, odd = F.col("event_type"), F.get_json_object("props", "$.k").cast("int") % 2 == 1
    reply = F.when(kind == "signup", " ").when(kind == "click", "no object here").when((kind == "view") & ~odd, F.concat(F.lit('Here it is: {"queries": ['), "props", F.lit("]}"))).otherwise(F.col("props"))
    error = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, "error: unknown option '--effort'").otherwise("timed out"))
    told = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e")).select("user_id", F.posexplode("e").alias("attempt", "e")).select("attempt", F.col("e.event_id").alias("event_id"))
    replies = events.join(told, "event_id").select(request_id(F.lit("plan"), user, F.lit(None).cast("string")).alias("id"), "attempt", F.lit("plan").alias("role"), reply.alias("reply"), error.alias("error"), kind.alias("model"), F.col("value").alias("cost"))
    ledger = Ledger(spark, fresh_path(spark, "ledger"), retries=RETRIES)
    ledger.apply(0, requests.where("user_id % 2 = 0"))
    ledger.apply(1, requests, outcomes(replies.where("attempt % 2 = 1")))
    ledger.apply(1, requests, outcomes(replies.where("attempt % 2 = 1").withColumn("cost", F.lit(1.0))))
    ledger.apply(2, attempts=outcomes(replies))
    due = ledger.due(BUDGET, ESTIMATE).select(F.col("id").alias("_id"), "allowed")
    states = ledger.states()
    return states.join(due, states["id"] == due["_id"], "left").select("id", "state", "kind", "effort", "tries", "next_attempt", F.round("cost", 4).alias("cost"), "allowed")
