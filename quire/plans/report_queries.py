"""Queries of what results say of themselves, over whole tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reports
from quire.plans.tables import query
from quire.plans.tables import table as _t


@query(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'author release' ELSE 'third-party reimplementation' END || CASE source WHEN 'src0' THEN ', high confidence' WHEN 'src1' THEN ', medium confidence' WHEN 'src2' THEN ', low confidence' ELSE '' END
  || CASE WHEN n_chars % 3 = 0 THEN ', host unreachable' ELSE '' END || CASE WHEN coalesce(text, '') <> '' THEN ' — ' || substr(text, 1, 200) ELSE '' END AS reason,
substr('2024-05-06: corrected from ' || coalesce(nullif(concat_ws(' and ', CASE WHEN n_chars % 2 = 0 THEN 'crossref' END, CASE WHEN n_chars % 5 = 0 THEN source END), ''), 'audit') || ' — ' || concat_ws('; ', 'venue: ' || lang, 'year: ' || n_chars) || CASE WHEN coalesce(text, '') <> '' THEN ' — ' || text ELSE '' END, 1, 600) AS note FROM documents"""
)
def provenance_lines(spark, sf_dir):
    """Where a code link and a correction come from, one line each, with texts as evidence."""
    n, source = F.col("n_chars"), F.col("source")
    sure = F.when(source == "src0", "high").when(source == "src1", "medium").when(source == "src2", "low").otherwise(source)
    sources = F.filter(F.array(F.when(n % 2 == 0, "crossref"), F.when(n % 5 == 0, source)), lambda x: x.isNotNull())
    changes = F.filter(F.array(F.concat(F.lit("venue: "), "lang"), F.concat(F.lit("year: "), n.cast("string"))), lambda x: x.isNotNull())
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", reports.code_reason(F.col("lang").isin("en", "fr"), sure, F.when(n % 3 == 0, "host unreachable").otherwise(""), F.col("text")).alias("reason"), reports.check_note(F.lit("2024-05-06"), sources, changes, F.col("text")).alias("note"))


@query(
    """WITH l AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS link, CASE strlen(coalesce(html, '')) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'absent' ELSE 'unavailable' END AS outcome FROM pages)
SELECT page_id, outcome <> 'absent' AS holds, CASE outcome WHEN 'absent' THEN 'does not resolve' WHEN 'ok' THEN '' ELSE 'link not verified (host unreachable)' END AS doubt, coalesce(regexp_matches(lower(link), '^https?://'), false) AND outcome <> 'absent' AS source_holds,
CASE WHEN starts_with(link, 'http://example.org/') THEN substr(link, 20) WHEN starts_with(link, 'https://example.org/') THEN link ELSE link END AS local FROM l"""
)
def link_answers(spark, sf_dir):
    """What a fetch's outcome says of a link and of a cited source, for every page's URL."""
    url = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    size = F.octet_length(F.coalesce("html", F.lit(""))) % 3
    rows = _t(spark, sf_dir, "pages").select("page_id", url.alias("link"), F.when(size == 0, "ok").when(size == 1, "absent").otherwise("unavailable").alias("outcome"))
    return rows.select("page_id", reports.link_answer(F.col("outcome")).alias("a"), reports.source_holds(F.col("link"), F.col("outcome")).alias("source_holds"), reports.relative_path(F.col("link"), F.lit("http://example.org")).alias("local")).select("page_id", "a.*", "source_holds", "local")


@query(
    """WITH e AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN '2001.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') WHEN doc_id % 3 = 1 THEN '' END AS arxiv, text FROM documents)
SELECT doc_id AS work, title, coalesce(arxiv, '') <> '' AS open_access, CASE WHEN coalesce(arxiv, '') <> '' THEN 'https://arxiv.org/pdf/' || arxiv END AS pdf_url,
CASE WHEN doc_id % 2 = 0 THEN '@article{k, title = {' || trim(coalesce(text, ''), ' ' || chr(10) || chr(13) || chr(9)) || '}}' END AS bibtex, CASE WHEN doc_id % 4 = 0 THEN 'Review' END AS kind FROM e"""
)
def records_of_entries(spark, sf_dir):
    """Entries as records to fetch again, an index's BibTeX answers, and kinds in an index's words."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    arxiv = F.when(k % 3 == 0, F.concat(F.lit("2001."), F.lpad((k % 100000).cast("string"), 5, "0"))).when(k % 3 == 1, "")
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \n\r\t"))
    body = F.when(k % 2 == 0, F.concat(F.lit("\n @article{k, title = {"), trimmed, F.lit("}} \r\n"))).otherwise(F.concat(F.lit("<html>@"), trimmed))
    docs = _t(spark, sf_dir, "documents").withColumns({"_bib": reports.index_bibtex(body), "_kind": reports.index_kind(F.when(k % 4 == 0, "review").otherwise("article"))})
    entries = docs.select(k.alias("key"), F.substring_index("text", "\n", 1).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(2001).alias("year"), none.alias("venue"), F.lit("other").alias("type"), none.alias("doi"), arxiv.alias("arxiv_id"), none.alias("url"), "_bib", "_kind")
    records = reports.record_of_entry(entries).select("work", "title", "open_access", "pdf_url")
    extra = entries.select(F.col("key").alias("_key"), F.col("_bib").alias("bibtex"), F.col("_kind").alias("kind"))
    return records.join(extra, F.col("work") == F.col("_key")).select("work", "title", "open_access", "pdf_url", "bibtex", "kind")


@query(
    """WITH c AS (SELECT o_custkey AS find, CASE o_orderstatus WHEN 'F' THEN 'references' WHEN 'O' THEN 'search' ELSE 'scout' END AS source, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'off topic' WHEN '2' THEN 'out of window' END AS dropped, CASE WHEN o_totalprice > 100000 THEN 1 END AS cites FROM orders),
k AS (SELECT user_id AS find, CASE WHEN event_type IN ('view', 'error') THEN 'search' ELSE 'weigh' END AS step, CASE WHEN value > 150 THEN 'unavailable' ELSE 'ok' END AS outcome FROM events),
p AS (SELECT find, count(*) AS total, count(*) FILTER (source = 'references') AS from_references, count(*) FILTER (source = 'search') AS from_search, count(*) FILTER (source = 'scout') AS from_scouts, count(*) FILTER (dropped = 'off topic') AS dropped_off_topic,
  count(*) FILTER (dropped = 'out of window') AS dropped_out_of_window, count(*) FILTER (dropped IS NULL AND cites IS NULL) AS ranked_without_citations FROM c GROUP BY find),
f AS (SELECT find, count(*) FILTER (step = 'search' AND outcome = 'unavailable') AS search_failures, count(*) FILTER (step = 'weigh' AND outcome = 'unavailable') AS weigh_failures FROM k GROUP BY find)
SELECT coalesce(p.find, f.find) AS find, coalesce(total, 0) AS total, coalesce(from_references, 0) AS from_references, coalesce(from_search, 0) AS from_search, coalesce(from_scouts, 0) AS from_scouts, coalesce(dropped_off_topic, 0) AS dropped_off_topic,
  coalesce(dropped_out_of_window, 0) AS dropped_out_of_window, coalesce(ranked_without_citations, 0) AS ranked_without_citations, coalesce(search_failures, 0) AS search_failures, coalesce(weigh_failures, 0) AS weigh_failures,
  coalesce(search_failures, 0) > 0 OR coalesce(weigh_failures, 0) > 0 AS degraded FROM p FULL JOIN f ON p.find = f.find"""
)
def find_reports(spark, sf_dir):
    """The report of every find: customers' orders as its candidates, users' events as its index calls."""
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    candidates = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("find"), F.when(status == "F", "references").when(status == "O", "search").otherwise("scout").alias("source"),
        F.when(priority == "1", "off topic").when(priority == "2", "out of window").alias("dropped"), F.when(F.col("o_totalprice") > 100000, 1).alias("citation_count"),
    )
    calls = _t(spark, sf_dir, "events").select(F.col("user_id").alias("find"), F.when(F.col("event_type").isin("view", "error"), "search").otherwise("weigh").alias("step"), F.when(F.col("value") > 150, "unavailable").otherwise("ok").alias("outcome"))
    return reports.find_report(candidates, calls)
