"""Queries of what was known when, of sketched statistics and of like vectors, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import history, sketches
from quire.operators.similar import VectorIndex
from quire.plans.tables import query
from quire.plans.tables import table as _t

_AT = "TIMESTAMP '1995-01-01' + INTERVAL 1 HOUR * (event_id * 7 % 60000)"


@query(
    f"""WITH c AS (SELECT o_custkey AS key, o_orderdate AS at, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT e.event_id, c.price FROM (SELECT event_id, user_id, {_AT} AS at FROM events) e ASOF LEFT JOIN c ON e.user_id = c.key AND e.at >= c.at"""
)
def as_of_values(spark, sf_dir):
    """The last price that a user's orders had by the time of each event; the greatest of one time."""
    at = F.expr("TIMESTAMP '1995-01-01 00:00:00'") + F.make_dt_interval(hours=(F.col("event_id") * 7 % 60000).cast("int"))
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), at.alias("at"))
    changes = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("price"))
    return history.as_of(rows, changes).select("event_id", "price")


@query(
    """WITH r AS (SELECT o_custkey AS key, unnest(['price', 'priority']) AS field, unnest([CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), o_orderpriority]) AS value, o_orderdate AS day FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30')
SELECT key, field, max(value) AS value FROM r JOIN (SELECT key AS k, field AS f, max(day) AS t FROM r GROUP BY key, field) ON key = k AND field = f AND day = t GROUP BY key, field"""
)
def state_at_time(spark, sf_dir):
    """What each customer's entry said at a day: the last price and priority."""
    orders = _t(spark, sf_dir, "orders")
    fields = F.explode(F.array(F.struct(F.lit("price").alias("field"), F.floor("o_totalprice").cast("string").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))).alias("f")
    changes = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), fields).select("key", "at", "f.*")
    return history.state_at(changes, "1998-06-30 00:00:00")


@query("SELECT l_returnflag AS library, count(*) AS rows, true AS parts_near, true AS price_near FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', count(*), true, true FROM lineitem")
def sketched_statistics(spark, sf_dir):
    """Distinct parts and quantiles of prices of each library and of all together, from sketches: rows, and that both are as near as stated."""
    items = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("shelf"), F.col("l_returnflag").alias("library"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"))
    shelves = sketches.sketched(items, ["library", "shelf"], distinct=("part",), quantiles=("price",))
    by_library = sketches.united(shelves, ["library"])
    every = sketches.united(by_library).withColumn("library", F.lit("all"))
    got = sketches.estimates(by_library.unionByName(every.select(*by_library.columns)))
    # Exact counts, and the ranks that the quantiles really have.
    both = items.unionByName(items.withColumn("library", F.lit("all")))
    quantiles = got.select("library", F.col("quantiles_price").alias("q"))
    ranks = both.join(F.broadcast(quantiles), "library").groupBy("library").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n"), *[F.count_if(F.col("price") <= F.col("q")[i]).alias(f"r{i}") for i in range(3)])
    right = got.join(ranks, "library")
    near = [F.abs(F.col(f"r{i}") / F.col("n") - x) <= sketches.RANK_ERROR + 2 / F.col("n") for i, x in enumerate((0.25, 0.5, 0.75))]
    return right.select("library", "rows", sketches.near(F.col("distinct_part"), F.col("parts")).alias("parts_near"), (near[0] & near[1] & near[2]).alias("price_near"))


@query(
    """WITH d AS (SELECT q.vec_id AS query, r.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))), 9) AS distance FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM d)
SELECT query, id, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM n WHERE place <= 10"""
)
def similar_entries(spark, sf_dir):
    """The ten nearest vectors of every fiftieth, from all: by cells, completed to the exact result."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    return VectorIndex.build(rows).search(queries, 10, exact=True).select("query", "id", F.round("distance", 6).alias("distance"), "place")
