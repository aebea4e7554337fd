"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame expressions only.

Each URL expands into every (host suffix, path prefix) expression that a rule could have; the first eight hex
digits of the expression's SHA-256 are equi-joined with those of the rules, the full digests confirm a match, and
the longest rule wins (a block before an allow where two are equally long).

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule, so it gets the
default verdict; repeated rows stay repeated; an empty table gives an empty result; only the id and URL columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

PREFIX_HEX = 8
#: Rule tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 500_000
RULE_SCHEMA = "verdict string, host string, path string"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a DataFrame."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """The text that is hashed: a host cannot hold a slash, so the first one ends it."""
    return F.concat(host, F.lit("\n"), path)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with digest, prefix and rank; of equal (host, path) pairs only the block stays."""
    rules = rules.select(F.col("verdict"), ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.where(F.col("host") != "").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(_key(F.col("host"), F.col("path")), 256)
    return rules.select(
        digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"), F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("length"), F.length("path").alias("path_length")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """page id, host, path, winning rule and verdict of every row of ``pages``."""
    ready = prepared_rules(rules)
    # The lengths of the rules' paths are few; they say which path prefixes are worth hashing.
    sizes = ready.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    lengths = F.array(*[F.lit(x) for x in sizes["lengths"]]).cast("array<int>")
    url = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    url = url.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split("host", r"\.")
    hosts = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    url = url.withColumns({"_hosts": hosts, "_paths": paths})
    expressions = F.flatten(F.transform("_hosts", lambda h: F.transform("_paths", lambda p: F.sha2(_key(h, p), 256))))
    url = url.withColumn("_e", expressions).select("page_id", "url", "host", "path", F.posexplode_outer("_e").alias("_k", "_digest"))
    url = url.withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    # Rules with one prefix form one row, so that an expression meets a row at most and keeps its own count.
    by_prefix = ready.groupBy("prefix").agg(F.collect_list(F.struct("length", "verdict", "rule", "digest")).alias("_rules"))
    side = F.broadcast(by_prefix) if sizes["n"] <= BROADCAST_RULES else by_prefix
    hit = url.join(side, url["_prefix"] == side["prefix"], "left")
    confirmed = F.filter("_rules", lambda r: r["digest"] == F.col("_digest"))
    best = F.max(F.when(F.size(confirmed) > 0, F.struct(confirmed[0]["length"].alias("length"), confirmed[0]["verdict"].alias("verdict"), confirmed[0]["rule"].alias("rule"))))
    # One expression of each row has place 0 (or none), so their count is the number of equal rows.
    rows = F.count_if(F.coalesce(F.col("_k"), F.lit(0)) == 0)
    found = hit.groupBy("page_id", "url", "host", "path").agg(best.alias("_best"), rows.alias("_n"))
    out = found.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy"))
    return out.drop("_copy")
