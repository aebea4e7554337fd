"""Queries of index clients, the inbox and the memory of links, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.tables import query
from quire.plans.tables import table as _t
from quire.sources import index_client, records
from quire.sources.resolvers import register_resolver, template
from quire.sources.storage import fresh_path
from quire.streaming.inbox import Inbox

HOSTS = ("api.crossref.org", "api.semanticscholar.org", "export.arxiv.org")
SPACES = {"api.semanticscholar.org": 1.25, "export.arxiv.org": 3.0}
PAGE_ROWS, FROM_YEAR, TO_YEAR = 20, 1995, 2001
_space = " ".join(f"WHEN '{h}' THEN {s}" for h, s in SPACES.items())


@query(
    f"""WITH w AS (SELECT p_partkey, p_name || ' ' || p_partkey AS title, 1990 + p_size % 15 AS year, CASE p_partkey % 3 WHEN 0 THEN '{HOSTS[0]}' WHEN 1 THEN '{HOSTS[1]}' ELSE '{HOSTS[2]}' END AS host FROM part),
n AS (SELECT *, (row_number() OVER (PARTITION BY host, year ORDER BY p_partkey) - 1) // {PAGE_ROWS} AS page FROM w WHERE year BETWEEN {FROM_YEAR} AND {TO_YEAR})
SELECT '10.5555/' || p_partkey AS doi, title, CAST(year AS INTEGER) AS year, host, CAST(page AS INTEGER) AS page, (dense_rank() OVER (PARTITION BY host ORDER BY year, page) - 1) * CASE host {_space} ELSE 0.0 END AS asked_at FROM n"""
)
def index_pages(spark, sf_dir):
    """Recorded answers of three indexes, a page for some works of a year: the years asked for are read and no others."""
    part = _t(spark, sf_dir, "part")
    year = 1990 + F.col("p_size") % 15
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), (F.col("p_partkey") % 3).cast("int"))
    message = F.struct(F.array(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("title"), F.concat(F.lit("10.5555/"), F.col("p_partkey").cast("string")).alias("DOI"), F.struct(F.array(F.array(year)).alias("date-parts")).alias("issued"))
    # Numbers within a host and year; a page is a group of them.
    listed = part.groupBy(host.alias("host"), year.alias("year")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(F.struct(message.alias("message"))).alias("m")))).alias("all"))
    numbered = listed.select("host", "year", F.posexplode("all").alias("i", "x")).withColumn("page", F.floor(F.col("i") / PAGE_ROWS).cast("int"))
    pages = numbered.groupBy("host", "year", "page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x.m"), ","), F.lit("]")).alias("payload"))
    folder = fresh_path(spark, "answers")
    index_client.record(pages, folder)
    asked = index_client.recorded(spark, folder, SPACES, year_from=FROM_YEAR, year_to=TO_YEAR, pages_per_task=10)
    answers = asked.select("host", "page", "asked_at", F.explode(F.from_json("payload", "array<string>")).alias("payload"))
    rows = records.from_crossref(answers.withColumn("work", F.concat_ws("|", "host", F.col("page").cast("string"), F.col("asked_at").cast("string"))))
    at = lambda i: F.split_part("work", F.lit("|"), F.lit(i))
    return rows.select("doi", "title", "year", at(1).alias("host"), at(2).cast("int").alias("page"), at(3).cast("double").alias("asked_at"))


_DROPPED = "CASE WHEN doc_id % 5 = 0 THEN 'Loose leaf number ' || (doc_id % 300) ELSE 'arXiv:' || lpad(CAST(doc_id % 4000 AS VARCHAR), 4, '0') || '.00042v1 [cs]' || chr(10) || 'A work of number ' || (doc_id % 4000) END || chr(10) || coalesce(text, '')"


@query(
    f"""WITH f AS (SELECT doc_id, doc_id % 3 AS batch, CASE WHEN doc_id % 5 = 0 THEN 'loose ' || (doc_id % 300) ELSE 'k' || (doc_id % 4000) END AS work, {_DROPPED} AS x FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY batch, doc_id) AS n FROM f),
e AS (SELECT 'k' || (p_partkey * 3 % 4000) AS work, arg_min('e' || p_partkey, (p_size % 2, 'e' || p_partkey)) AS entry FROM part GROUP BY 1),
o AS (SELECT r.*, entry, row_number() OVER (PARTITION BY r.work, n = 1 ORDER BY batch, doc_id) AS k FROM r LEFT JOIN e ON r.work = e.work)
SELECT doc_id, entry, CASE WHEN n > 1 THEN 'repeated' WHEN entry IS NOT NULL OR k > 1 THEN 'updated' ELSE 'added' END AS status FROM o"""
)
def inbox_filed(spark, sf_dir):
    """Every document dropped as a file, in three batches of which one comes twice: which entry it belongs to, or whether it opens a work."""
    number = lambda n: (F.col("doc_id") % n).cast("string")
    stamped = F.concat(F.lit("arXiv:"), F.lpad(number(4000), 4, "0"), F.lit(".00042v1 [cs]\nA work of number "), number(4000))
    text = F.concat(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Loose leaf number "), number(300))).otherwise(stamped), F.lit("\n"), F.coalesce("text", F.lit("")))
    files = _t(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), text.alias("text"), (F.col("doc_id") % 3).alias("batch"))
    none = F.lit(None).cast("string")
    held = _t(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("key"), none.alias("title"), none.alias("doi"), F.concat(F.lpad((F.col("p_partkey") * 3 % 4000).cast("string"), 4, "0"), F.lit(".00042")).alias("arxiv_id"), F.when(F.col("p_size") % 2 == 0, "unread").otherwise("verified").alias("status"))
    inbox = Inbox(spark, fresh_path(spark, "inbox"), lambda: held)
    for batch in (0, 1, 1, 2):
        inbox.apply(batch, files.where(F.col("batch") == batch).select("path", "text"))
    rows = inbox.filed().where("batch < 3").select(F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long").alias("doc_id"), F.when(F.col("key").rlike(r"^e\d+$"), F.col("key")).alias("_key"), "status", "digest")
    return rows.select("doc_id", F.col("_key").alias("entry"), "status")


@query(
    """WITH w AS (SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars % 4 = 1 THEN ' ' ELSE '10.5555/' || source || '.' || doc_id END AS doi FROM documents), t AS (SELECT * FROM w WHERE trim(doi) <> '')
SELECT doc_id, 'https://files.example.org/' || doi || '.pdf' AS url, 'files' AS label FROM t UNION ALL SELECT doc_id, 'https://mirror.example.org/' || doc_id % 7 || '/' || doi, 'mirrors' FROM t WHERE doc_id % 7 < 3"""
)
def resolver_links(spark, sf_dir):
    """Candidates of two registered resolvers for every document with a DOI, by lateral joins in SQL."""
    n = F.col("n_chars") % 4
    doi = F.when(n == 0, F.lit(None)).when(n == 1, " ").otherwise(F.concat(F.lit("10.5555/"), "source", F.lit("."), F.col("doc_id").cast("string")))
    works = _t(spark, sf_dir, "documents").select("doc_id", doi.alias("doi"))

    def mirrors(doi):
        shelf = int(doi.rsplit(".", 1)[1]) % 7
        return [f"https://mirror.example.org/{shelf}/{doi}"] if shelf < 3 else []

    register_resolver(spark, "files_resolver", template("https://files.example.org/{doi}.pdf"), "files")
    register_resolver(spark, "mirror_resolver", mirrors, "mirrors")
    found = [spark.sql(f"SELECT w.doc_id, r.url, r.label FROM {{works}} w, LATERAL {name}(w.doi) r WHERE r.error IS NULL", works=works) for name in ("files_resolver", "mirror_resolver")]
    return found[0].unionByName(found[1])
