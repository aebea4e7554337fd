"""What results say of themselves: provenance lines, answers of links in three values, counts of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.identifiers import blank_to_null

#: How much of a piece of evidence a line quotes, and how long a check's note is.
EVIDENCE_CHARS, NOTE_CHARS = 200, 600
CONFIDENCES = ("high", "medium", "low")


def code_reason(official: Column, confidence: Column, note: Column, evidence: Column) -> Column:
    """Where a repository link comes from: whose it is, how sure that is, what is in doubt, and the evidence."""
    who = F.when(F.coalesce(official, F.lit(False)), "author release").otherwise("third-party reimplementation")
    line = F.concat_ws(", ", who, F.when(confidence.isin(*CONFIDENCES), F.concat(confidence, F.lit(" confidence"))), blank_to_null(note))
    return F.concat(line, F.coalesce(F.concat(F.lit(" — "), F.substring(blank_to_null(evidence), 1, EVIDENCE_CHARS)), F.lit("")))


def check_note(day: Column, sources: Column, changes: Column, evidence: Column) -> Column:
    """The dated line about a corrected entry: who confirmed what."""
    where = F.when(F.size(sources) > 0, F.array_join(sources, " and ")).otherwise("audit")
    line = F.concat(day, F.lit(": corrected from "), where, F.lit(" — "), F.array_join(changes, "; "), F.coalesce(F.concat(F.lit(" — "), blank_to_null(evidence)), F.lit("")))
    return F.substring(line, 1, NOTE_CHARS)


def link_answer(outcome: Column) -> Column:
    """holds, doubt of a link by what a fetch found (ok or exists, absent, else nothing): absent is an answer, no answer is not."""
    held = F.coalesce(outcome != "absent", F.lit(True))
    doubt = F.when(outcome == "absent", "does not resolve").when(outcome.isin("ok", "exists"), "").otherwise("link not verified (host unreachable)")
    return F.struct(held.alias("holds"), doubt.alias("doubt"))


def source_holds(url: Column, outcome: Column) -> Column:
    """Whether a cited source may be believed to exist: a web address that no host has denied."""
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False)) & link_answer(outcome)["holds"]


def relative_path(path: Column, root: Column) -> Column:
    """A path within ``root`` from there, any other as it is."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def index_kind(kind: Column) -> Column:
    """A plan's kind of work in the vocabulary of the index that knows one."""
    return F.when(kind == "review", "Review")


def record_of_entry(entries: DataFrame) -> DataFrame:
    """work and the fields of a record that say where an entry's full text may be."""
    arxiv = blank_to_null(F.col("arxiv_id"))
    return entries.select(F.col("key").alias("work"), "title", "authors", "year", "venue", "type", "doi", arxiv.alias("arxiv_id"), "url", arxiv.isNotNull().alias("open_access"), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv).alias("pdf_url"))


def index_bibtex(body: Column) -> Column:
    """A BibTeX answer of an index; null if it is something else."""
    text = F.btrim(F.coalesce(body, F.lit("")), F.lit(" \n\r\t"))
    return F.when(text.startswith("@"), text)


def find_report(candidates: DataFrame, calls: DataFrame) -> DataFrame:
    """A row for each find: its pool by origin, what was dropped, which index calls failed, and whether that degrades it.

    ``candidates`` has find, source, dropped (off topic, out of window or null) and citation_count; ``calls`` find, step
    (search or weigh) and outcome.
    """
    n = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    source, dropped = F.col("source"), F.col("dropped")
    pool = candidates.groupBy("find").agg(
        F.count("*").alias("total"), n(source == "references", "from_references"), n(source == "search", "from_search"), n(source == "scout", "from_scouts"),
        n(dropped == "off topic", "dropped_off_topic"), n(dropped == "out of window", "dropped_out_of_window"), n(dropped.isNull() & F.col("citation_count").isNull(), "ranked_without_citations"),
    )
    failed = F.col("outcome") == "unavailable"
    asked = calls.groupBy(F.col("find").alias("_find")).agg(n(failed & (F.col("step") == "search"), "search_failures"), n(failed & (F.col("step") == "weigh"), "weigh_failures"))
    rows = pool.join(asked, pool["find"].eqNullSafe(asked["_find"]), "full_outer")
    numbers = [c for c in rows.columns if c not in ("find", "_find")]
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers]
    out = rows.select(F.coalesce("find", "_find").alias("find"), *counts)
    return out.withColumn("degraded", (F.col("search_failures") > 0) | (F.col("weigh_failures") > 0))
