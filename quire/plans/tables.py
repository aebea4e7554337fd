"""The registry of queries, and the driver's tables as a library sees them.

Documents are full texts (the first line is the title), orders are entries (the priority is the level, the date the
year), line items are citations (an order cites a part), parts are cited works, conversations are sections, events are
changes and requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(priority: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in ("A*", "A", "B", "C", "unranked")]), F.substring(priority, 1, 1).cast("int") - 1)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries; every eleventh customer's entries have no year."""
    c = F.col
    status = F.when(c("o_orderstatus") == "F", "verified").when(c("o_orderstatus") == "O", "unread").otherwise("UNVERIFIED")
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("key"), F.concat(F.lit("Order "), c("o_orderkey").cast("string")).alias("title"), _level(c("o_orderpriority")).alias("level"), F.when(c("o_custkey") % 11 != 0, F.year("o_orderdate")).alias("year"),
        status.alias("status"), F.when(c("o_custkey") % 2 == 0, "journal article").otherwise("conference paper").alias("type"), F.split(F.lower(F.substring("o_orderpriority", F.lit(3), F.lit(20))), " ").alias("tags"),
        c("o_custkey").alias("citation_count"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("added"),
    )


ENTRIES = """
SELECT o_orderkey AS key, 'Order ' || o_orderkey AS title,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A*' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '4' THEN 'C' ELSE 'unranked' END AS level,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 4 END AS lrank,
  CASE WHEN o_custkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unread' ELSE 'UNVERIFIED' END AS status,
  CASE WHEN o_custkey % 2 = 0 THEN 'journal article' ELSE 'conference paper' END AS type,
  string_split(lower(substr(o_orderpriority, 3)), ' ') AS tags, o_custkey AS citation_count, strftime(o_orderdate, '%Y-%m-%d') AS added
FROM orders
"""
