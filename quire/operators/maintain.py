"""Keeping a library right: audits, refreshes, merges of records and libraries, index sync, notes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import arxiv_year, escapes_library
from quire.functions.venues import clean_venue, is_placeholder, is_preprint_host, is_publisher, is_workshop
from quire.operators.identity import find_duplicates
from quire.operators.search import level_rank

# Fixed values of the audit and of merged notes.
STALE_YEARS = 3
FIRST_YEAR = 1500
NOTES_HEADING = "### Notes from "


def audit(entries: DataFrame, as_of_year: int) -> DataFrame:
    """key, field, problem: metadata that is implausible, one row a finding."""
    entries = entries.withColumn("_venue", clean_venue(F.col("venue")))
    v, raw, year, kind = F.col("_venue"), F.coalesce("venue", F.lit("")), F.col("year"), F.coalesce("type", F.lit(""))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    say = lambda field, *text: F.struct(F.lit(field).alias("field"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("problem"))
    posted, age = arxiv_year(F.col("arxiv_id")), F.when(year != 0, F.lit(as_of_year) - year)
    rules = [
        F.when((raw != "") & v.isNull(), say("venue", "venue ", quoted(raw), " is not a usable venue name"))
        .when(is_publisher(v), say("venue", "venue ", quoted(v), " names a publisher, not a venue"))
        .when(v.isNotNull() & is_preprint_host(v), say("venue", "venue ", quoted(v), " names a preprint server, not a venue"))
        .when(v.isNull() & kind.isin("conference paper", "journal article"), say("venue", "a ", kind, " with no venue recorded")),
        F.when(v.isNotNull() & is_workshop(v) & ~kind.isin("workshop paper", "other"), say("type", "venue names a workshop but type is ", quoted(kind))),
        F.when(year.isNull(), say("year", "no year recorded"))
        .when((year > as_of_year + 1) | (year < FIRST_YEAR), say("year", "year ", year.cast("string"), " is implausible"))
        .when(year < posted, say("year", "year ", year.cast("string"), " predates the paper's own arXiv posting (", posted.cast("string"), ")")),
        F.when((F.coalesce("citation_count", F.lit(0)) == 0) & (age >= STALE_YEARS), say("citation_count", "no citations recorded for a paper ", age.cast("string"), " years old")),
        F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, say("authors", "no authors recorded")).when((F.size("authors") == 1) & F.get("authors", F.lit(0)).rlike(r"(?i)\bet\.?\s*al\.?"), say("authors", "author list collapsed to ", quoted(F.get("authors", F.lit(0))))),
        F.when(F.col("title").rlike(r"(?i)<[^>]+>|&[a-z]+;|&#\d+;"), say("title", "title still carries unrendered markup")),
    ]
    return entries.select("key", F.inline(F.array_compact(F.array(*rules))))


def vetted(corrections: DataFrame, as_of_year: int) -> DataFrame:
    """Proposed corrections (key, field, proposed, source) with ok and why: is the value plausible for its field?"""
    p, field = F.trim("proposed"), F.col("field")
    year = p.try_cast("int")
    bad = (
        F.when(F.coalesce(p, F.lit("")) == "", "nothing was proposed")
        .when(F.coalesce("source", F.lit("")) == "", "no source was given")
        .when((field == "venue") & (clean_venue(p).isNull() | is_placeholder(p)), "not a venue")
        .when((field == "year") & ~F.coalesce(year.between(FIRST_YEAR, as_of_year + 1), F.lit(False)), "not a plausible year")
        .when(~field.isin("venue", "year", "type", "title"), "not a field that may be corrected")
    )
    return corrections.withColumns({"ok": bad.isNull(), "why": bad})


def check_status(before: Column, after: Column, applied: Column, confirmed: Column, fix: bool) -> Column:
    """The status of a checked entry from its numbers of findings and corrections."""
    return F.when((before == 0) & (applied == 0), "clean").when(applied > 0, "fixed" if fix else "proposed").when(confirmed | (after == 0), "confirmed").otherwise("unresolved")


def refreshed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """key, changes and the new values: what fresh records change in stored entries.

    Counts follow the record, reference lists only grow, DOI, abstract and BibTeX fill gaps, a venue replaces a placeholder.
    """
    f = fresh.select("key", *[F.col(c).alias(f"_{c}") for c in ("citation_count", "references", "doi", "venue", "bibtex", "abstract")])
    rows = stored.join(f, "key").withColumns({"_held": is_placeholder(F.col("venue")), "_vain": is_placeholder(F.col("_venue"))})
    gap = lambda c: (F.coalesce(c, F.lit("")) == "") & (F.coalesce(f"_{c}", F.lit("")) != "")
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    cites = F.col("_citation_count").isNotNull() & ~F.col("_citation_count").eqNullSafe(F.col("citation_count"))
    longer = size("_references") > size("references")
    venue = (F.coalesce("_venue", F.lit("")) != "") & ~F.col("_vain") & ((F.coalesce("venue", F.lit("")) == "") | F.col("_held")) & ~F.col("_venue").eqNullSafe(F.col("venue"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    changes = F.array_compact(
        F.array(
            F.when(cites, F.concat(F.lit("citations "), shown("citation_count"), F.lit(" -> "), shown("_citation_count"))),
            F.when(longer, F.concat(F.lit("references "), size("references").cast("string"), F.lit(" -> "), size("_references").cast("string"))),
            F.when(gap("doi"), F.concat(F.lit("doi "), F.col("_doi"))),
            F.when(venue, F.concat(F.lit("venue "), shown("venue"), F.lit(" -> "), F.col("_venue"))),
            F.when(gap("bibtex"), F.lit("bibtex")),
            F.when(gap("abstract"), F.lit("abstract")),
        )
    )
    new = {"citation_count": F.when(cites, F.col("_citation_count")).otherwise(F.col("citation_count")), "references": F.when(longer, F.col("_references")).otherwise(F.col("references")), "venue": F.when(venue, F.col("_venue")).otherwise(F.col("venue"))}
    new |= {c: F.when(gap(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("doi", "bibtex", "abstract")}
    return rows.withColumn("changes", changes).withColumns(new).select(*stored.columns, "changes")


def merged_records(records: DataFrame) -> DataFrame:
    """One record a work from several sources by priority: blanks filled, largest count, longest references, real venue first."""
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("priority"))).alias(c)
    own = lambda c: F.min_by(c, F.when((F.coalesce(F.col(c), F.lit("")) != "") & ~F.coalesce("title_matched", F.lit(False)), F.col("priority"))).alias(c)
    venue = F.min_by("venue", F.when(F.coalesce("venue", F.lit("")) != "", F.struct(is_placeholder(F.col("venue")).alias("p"), F.col("priority")))).alias("venue")
    kind = F.min_by("type", F.when(~F.coalesce("type", F.lit("other")).isin("", "other"), F.col("priority")))
    return records.groupBy("work").agg(
        filled("title"), own("doi"), own("arxiv_id"), filled("url"), filled("abstract"), filled("pdf_url"), filled("pmcid"), filled("bibtex"), venue,
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("priority"))).alias("year"), F.min_by("authors", F.when(F.size("authors") > 0, F.col("priority"))).alias("authors"),
        F.max("citation_count").alias("citation_count"), F.coalesce(kind, F.lit("other")).alias("type"), F.max_by("references", F.struct(F.size("references"), -F.col("priority"))).alias("references"),
        F.transform(F.array_sort(F.collect_list(F.struct("priority", "source"))), lambda x: x["source"]).alias("sources"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str = "key", stamp: str = "mtime", tolerance: float = 1e-6, force: bool = False) -> DataFrame:
    """key, change of two snapshots: insert, update, delete or unchanged."""
    a, b = old.select(F.col(key), F.col(stamp).alias("_old")), new.select(F.col(key).alias("_key"), F.col(stamp).alias("_new"))
    moved = F.abs(F.col("_new").cast("double") - F.col("_old").cast("double")) >= tolerance
    change = F.when(F.col(key).isNull(), "insert").when(F.col("_key").isNull(), "delete").when(moved | F.lit(force), "update").otherwise("unchanged")
    return a.join(b, a[key] == b["_key"], "full_outer").select(F.coalesce(key, "_key").alias(key), change.alias("change"))


def applied_diff(index: DataFrame, rows: DataFrame, diff: DataFrame, *, key: str = "key") -> DataFrame:
    """The index after a sync: changed and vanished rows out, changed and new ones in."""
    gone = diff.where("change <> 'unchanged'").select(key)
    return index.join(gone, key, "left_anti").unionByName(rows.join(diff.where("change in ('insert', 'update')").select(key), key, "left_semi"))


def imported(mine: DataFrame, theirs: DataFrame, *, strategy: str = "newer", library: str = "import") -> DataFrame:
    """key, status, reason and the merged fields of each incoming entry.

    One work is found by DOI, arXiv id or title. ``skip`` keeps mine, ``replace`` takes theirs, ``newer`` takes theirs if
    it is as new and does not trade a reading for none. The own key, added date and notes stay; foreign notes are
    appended. A key that would leave its folder is refused, and one that another work has is reported as taken.
    """
    own = mine.select(F.col("key").alias("_mine"), F.col("status").alias("_status"), F.col("updated").alias("_updated"), F.col("added").alias("_added"), F.col("notes").alias("_notes"))
    match = find_duplicates(theirs.select(F.col("key").alias("id"), "doi", "arxiv_id", "title"), mine).select(F.col("id").alias("_theirs"), F.col("key").alias("_match"))
    taken = mine.select(F.col("key").alias("_taken"))
    rows = theirs.join(match, theirs["key"] == match["_theirs"], "left").join(own, F.col("_match") == F.col("_mine"), "left").join(taken, theirs["key"] == taken["_taken"], "left")
    found = F.col("_mine").isNotNull()
    older = F.coalesce("updated", F.lit("")) < F.coalesce("_updated", F.lit(""))
    loses = (F.col("_status") == "verified") & (F.col("status") != "verified")
    reason = F.when(escapes_library(F.col("key")), "unsafe key").when(found & F.lit(strategy == "skip"), "already in the library").when(found & F.lit(strategy == "newer") & older, "mine is newer").when(found & F.lit(strategy == "newer") & loses, "mine is read, theirs is not")
    status = F.when(reason.isNotNull(), "skipped").when(found, "updated").otherwise("added")
    foreign = F.when((F.coalesce("notes", F.lit("")) != "") & ~F.contains(F.coalesce("_notes", F.lit("")), F.col("notes")), F.concat(F.lit(f"{NOTES_HEADING}{library}\n\n"), F.col("notes")))
    notes = F.when(found, F.concat_ws("\n\n", F.nullif("_notes", F.lit("")), foreign)).otherwise(F.col("notes"))
    return rows.select(
        F.coalesce("_mine", "key").alias("key"), F.col("key").alias("incoming"), status.alias("outcome"), F.coalesce(reason, F.lit("")).alias("reason"), (~found & F.col("_taken").isNotNull()).alias("key_taken"),
        "title", "status", "updated", F.when(found, F.coalesce("_added", "added")).otherwise(F.col("added")).alias("added"), notes.alias("notes"),
    )


def saved(disk: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries to write: incoming ones with the notes that are on disk, whatever they bring."""
    d = disk.select("key", F.col("notes").alias("_notes"), F.lit(True).alias("_there"))
    return incoming.join(d, "key", "left").withColumn("notes", F.when(F.col("_there"), F.col("_notes")).otherwise(F.col("notes"))).select(*incoming.columns)


def carried_reading(entry: DataFrame, existing: DataFrame) -> DataFrame:
    """New entries with the reading and code link of verified ones that they replace."""
    fields = ["one_liner", "sections", "key_findings", "read_source", "text_chars", "pages", "pages_read"]
    old = existing.select("key", F.col("status").alias("_status"), F.col("code_url").alias("_code_url"), F.col("code_source").alias("_code_source"), *[F.col(c).alias("_" + c) for c in fields])
    rows, read = entry.join(old, "key", "left"), F.col("_status") == "verified"
    out = {c: F.when(read, F.col("_" + c)).otherwise(F.col(c)) for c in fields} | {"status": F.when(read, F.lit("verified")).otherwise(F.col("status"))}
    gap = F.coalesce("code_url", F.lit("")) == ""
    out |= {c: F.when(gap, F.col("_" + c)).otherwise(F.col(c)) for c in ("code_url", "code_source")}
    return rows.withColumns(out).select(*entry.columns)


def reading_elsewhere(wanted: DataFrame, libraries: DataFrame, here: str) -> DataFrame:
    """id, library, key: a verified reading of the wanted works in a sibling library, the first in library order."""
    read = libraries.where((F.col("library") != here) & (F.col("status") == "verified") & (F.coalesce("one_liner", F.lit("")) != ""))
    read = read.withColumn("key", F.concat_ws("\u0001", "library", "key"))
    found = find_duplicates(wanted, read)
    return found.select("id", F.split_part("key", F.lit("\u0001"), F.lit(1)).alias("library"), F.split_part("key", F.lit("\u0001"), F.lit(2)).alias("key"))


def statistics(entries: DataFrame) -> DataFrame:
    """facet, value, n: all entries, by level, status and type, in one pass over grouping sets."""
    rows = entries.select(F.coalesce("level", F.lit("unranked")).alias("level"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("type", F.lit("")).alias("type"))
    sets = rows.groupingSets([[], ["level"], ["status"], ["type"]], "level", "status", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    facet = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "level").when(F.col("_g") == 5, "status").otherwise("type")
    return sets.select(facet.alias("facet"), F.coalesce("level", "status", "type").alias("value"), "n")


def library_totals(entries: DataFrame) -> DataFrame:
    """entries, references and the first and last year."""
    refs = F.sum(F.greatest(F.lit(0), F.coalesce(F.size("references"), F.lit(0))))
    return entries.agg(F.count("*").alias("entries"), F.coalesce(refs, F.lit(0)).cast("long").alias("references"), F.min(F.nullif("year", F.lit(0))).alias("first_year"), F.max("year").alias("last_year"))


def top_tags(entries: DataFrame, limit: int = 20) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(limit)


def throttled(requests: DataFrame, seconds: float, *, host: str = "host", at: str = "at") -> DataFrame:
    """Adds ``wait``: how long each request waits so that a host's requests stand ``seconds`` apart.

    Slot n of a host is the latest of arrival i + (n - i) * seconds over i <= n, which is a running maximum.
    """
    order = Window.partitionBy(host).orderBy(at, *[c for c in requests.columns if c not in (host, at)])
    n = F.row_number().over(order)
    rows = requests.withColumn("_n", n).withColumn("_base", F.col(at).cast("double") - F.col("_n") * seconds)
    slot = F.max("_base").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * seconds
    return rows.withColumn("wait", F.round(slot - F.col(at).cast("double"), 3)).drop("_n", "_base")


def by_level(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("level", F.lit("unranked")).alias("level")).agg(F.count("*").alias("n")).orderBy(level_rank(F.col("level")))
