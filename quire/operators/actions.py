"""Whole commands as dataflows: discover, add, check, find code, drain an inbox, ask and trace a claim.

Each takes tables and a provider and returns tables with a status; nothing loops over rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.documents import clip_words, usable
from quire.functions.identifiers import citation_key, folded, identity, normal_arxiv, normal_code_url, normal_doi, normal_tags, slug
from quire.functions.venues import venue_levels
from quire.operators import citations, maintain, quality, ranking
from quire.operators.identity import find_duplicates, match_cascade, unique_keys
from quire.operators.reports import code_reason, link_answer
from quire.operators.search import search
from quire.plans.planning import SearchPlan
from quire.plans.providers import Provider

# What a reading may hold.
SECTIONS, SECTION_WORDS, FINDINGS, TAGS, QUOTES = 8, 120, 6, 12, 4
#: Fields that a checker may correct.
CORRECTED = ("venue", "year", "type", "title")


def as_candidates(records: DataFrame, angle: str, source: str, start: int = 0) -> DataFrame:
    """Index records as candidates of an angle; titles that are too short are out."""
    rows = records.where(F.length("title") >= ranking.SHORTEST_TITLE)
    return rows.select(
        (F.lit(start) + F.monotonically_increasing_id()).alias("arrival"), "title", "authors", "year", "venue", "doi", "arxiv_id", "url", F.lit(None).cast("string").alias("why"), F.array(F.lit(angle)).alias("angles"), "citation_count",
        F.lit(0).alias("cocitations"), F.lit(source).alias("source"),
    )


def scouted(papers: DataFrame, start: int = 0) -> DataFrame:
    """A scout's papers (angle, title, authors, year, doi, arxiv_id, url, why) as candidates, leniently."""
    return papers.where(F.length(F.trim("title")) >= ranking.SHORTEST_TITLE).select(
        (F.lit(start) + F.monotonically_increasing_id()).alias("arrival"), F.trim("title").alias("title"), "authors", F.substring(F.col("year").cast("string"), 1, 4).try_cast("int").alias("year"), F.lit(None).cast("string").alias("venue"),
        normal_doi(F.col("doi")).alias("doi"), normal_arxiv(F.col("arxiv_id")).alias("arxiv_id"), "url", "why", F.array("angle").alias("angles"), F.lit(None).cast("bigint").alias("citation_count"), F.lit(0).alias("cocitations"), F.lit("scout").alias("source"),
    )


def discover(entries: DataFrame, found: DataFrame, plan: SearchPlan, as_of_year: int, *, limit: int = 10, records: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """Candidates from the library's references and from ``found``, merged, cut, enriched, judged and ranked."""
    mined = citations.mine_references(entries).limit(ranking.mined_intake(limit))
    mined = mined.select(
        F.monotonically_increasing_id().alias("arrival"), "title", "authors", "year", F.lit(None).cast("string").alias("venue"), "doi", "arxiv_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("why"),
        F.array().cast("array<string>").alias("angles"), F.lit(None).cast("bigint").alias("citation_count"), "cocitations", F.lit("references").alias("source"),
    )
    pool = ranking.absorbed(mined.unionByName(found.withColumn("arrival", F.col("arrival") + (1 << 50))))
    known = entries.select(identity(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("dedup_key")).distinct()
    titles = entries.select(slug(F.col("title"), 120).alias("_slug")).distinct()
    pool = pool.join(known, "dedup_key", "left_anti").withColumn("_slug", slug(F.col("title"), 120)).join(titles, "_slug", "left_anti").drop("_slug")
    inside = ranking.within_window(F.col("year"), plan.year_from, plan.year_to)
    order = [*ranking.triage(F.size("angles"), F.col("cocitations"), F.col("year")), F.col("dedup_key")]
    pool = ranking.trimmed(pool.where(inside), ranking.pool_cap(limit), strong=ranking.corroborated(F.col("cocitations"), F.size("angles")), order=order)
    if records is not None:
        pool = ranking.enriched(pool, records).where(inside)
    scores = provider.answer("rank", pool.select("dedup_key")) if provider else None
    pool = ranking.with_relevance(pool, scores) if scores is not None else pool.withColumn("relevance", F.lit(None).cast("double"))
    pool = venue_levels(pool).withColumn("level", F.col("venue_level.level")).drop("venue_level")
    return ranking.ranked(pool, limit, as_of_year)


def pool_report(candidates: DataFrame) -> DataFrame:
    """How a pool came about, in one row."""
    n = lambda source: F.count_if(F.col("source") == source)
    return candidates.agg(F.count("*").alias("total"), n("references").alias("from_references"), n("search").alias("from_search"), n("scout").alias("from_scouts"), n("both").alias("from_both"), F.count_if(F.col("citation_count").isNull()).alias("without_citations"))


def apply_reading(drafts: DataFrame, readings: DataFrame, level_names: tuple[str, ...] = ("A*", "A", "B", "C", "unranked")) -> DataFrame:
    """Drafts with a reader's answer (key, one_liner, sections, key_findings, tags, code_url), cut to what an entry may hold."""
    r = readings.select("key", *[F.col(c).alias("_" + c) for c in ("one_liner", "sections", "key_findings", "tags", "code_url", "text")])
    rows, read = drafts.join(r, "key", "left"), F.coalesce("_one_liner", F.lit("")) != ""
    sections = F.transform(F.slice(F.filter("_sections", lambda s: F.trim(s["summary"]) != ""), 1, SECTIONS), lambda s: F.struct(F.coalesce(F.nullif(F.trim(s["name"]), F.lit("")), F.lit("Section")).alias("name"), clip_words(s["summary"], SECTION_WORDS).alias("summary")))
    # A link counts only if the text prints it.
    link = normal_code_url(F.col("_code_url"))
    printed = F.contains(folded(F.col("_text")), folded(F.regexp_replace(link, r"^https?://", "")))
    out = {
        "one_liner": F.when(read, F.trim("_one_liner")).otherwise(F.col("one_liner")), "sections": F.when(read, sections).otherwise(F.col("sections")), "key_findings": F.when(read, F.slice("_key_findings", 1, FINDINGS)).otherwise(F.col("key_findings")),
        "tags": F.when(read, normal_tags(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_tags", F.array().cast("array<string>"))), TAGS)).otherwise(F.col("tags")), "status": F.when(read, F.lit("verified")).otherwise(F.col("status")),
        "code_source": F.when(read & link.isNotNull() & printed & F.col("code_url").isNull(), F.lit("paper")).otherwise(F.col("code_source")), "code_url": F.when(read & link.isNotNull() & printed & F.col("code_url").isNull(), link).otherwise(F.col("code_url")),
    }
    return rows.withColumns(out).select(*drafts.columns)


def add_papers(entries: DataFrame, records: DataFrame, fulltexts: DataFrame, as_of_year: int, *, min_level: str = "C", allow_non_published: bool = False, provider: Provider | None = None, read: bool = True, refresh: bool = False, siblings: DataFrame | None = None) -> DataFrame:
    """work, outcome, reason and the drafted entry of each record: duplicate, rejected, not_found, added or updated.

    ``records`` are merged ones (one a work), ``fulltexts`` have doc (the work), text, pages and pages_read. With
    ``refresh`` a work that is there is drafted anew under its key and keeps its earlier reading and code link unless it
    was read anew. ``siblings`` (library, key, doi, arxiv_id, title, status, one_liner) are entries of other libraries:
    ``elsewhere`` names a finished reading among them.
    """
    wanted = records.select(F.col("work").alias("id"), "doi", "arxiv_id", "title")
    rows = venue_levels(records).join(find_duplicates(wanted, entries).select(F.col("id").alias("work"), F.col("key").alias("duplicate")), "work", "left")
    c = F.col
    rows = rows.withColumn("verdict", quality.assessed(c("venue"), c("type"), c("year"), c("citation_count"), as_of_year, c("venue_level")))
    rows = rows.withColumn("bar", quality.passes_bar(c("verdict"), c("type"), min_level, allow_non_published))
    rows = rows.join(fulltexts.select(c("doc").alias("work"), c("text").alias("full"), "pages", "pages_read"), "work", "left")
    named = unique_keys(rows.select("work", citation_key(c("authors"), c("year"), c("title")).alias("base")), entries.select("key"), order="work").select("work", "key")
    has_text = usable(c("full"), c("pages_read"))
    outcome = F.when(F.coalesce("title", F.lit("")) == "", "not_found").when(c("duplicate").isNotNull(), "updated" if refresh else "duplicate").when(~c("bar")["ok"], "rejected").otherwise("added")
    reason = F.when(outcome == "duplicate", c("duplicate")).when(outcome == "rejected", c("bar")["why"]).otherwise(F.when(has_text, "").otherwise("no full text"))
    none = F.lit(None).cast("string")
    drafts = rows.join(named, "work").select(
        "work", F.when(outcome == "updated", c("duplicate")).otherwise(c("key")).alias("key"), outcome.alias("outcome"), reason.alias("reason"), "title", "authors", "year", "venue", "type", "doi", "arxiv_id", "url", "abstract", "citation_count", "references", "bibtex", c("verdict.level").alias("level"), c("verdict.reason").alias("level_reason"),
        F.when(F.lit(read) & ~has_text, "UNVERIFIED").otherwise("unread").alias("status"), "pages", "pages_read", F.length("full").cast("long").alias("text_chars"), none.alias("one_liner"),
        F.array().cast("array<struct<name:string,summary:string>>").alias("sections"), F.array().cast("array<string>").alias("key_findings"), F.array().cast("array<string>").alias("tags"), none.alias("code_url"), none.alias("code_source"), none.alias("read_source"), c("full").alias("text"),
    )
    answers = provider.answer("reader", drafts.where("outcome in ('added', 'updated')").select("key", "work")) if read and provider else None
    if answers is not None:
        drafts = apply_reading(drafts, answers.join(drafts.select("key", "text"), "key"))
    drafts = drafts.drop("text")
    if refresh:
        again = (F.col("outcome") == "updated") & (F.col("status") != "verified")
        drafts = maintain.carried_reading(drafts.where(again), entries).unionByName(drafts.where(~again))
    if siblings is None:
        return drafts.withColumn("elsewhere", none)
    read_there = maintain.reading_elsewhere(wanted, siblings, "").select(F.col("id").alias("work"), F.concat_ws("/", "library", "key").alias("elsewhere"))
    return drafts.join(read_there, "work", "left")


def corrections(entries: DataFrame, as_of_year: int, provider: Provider | None) -> DataFrame | None:
    """key and the plausible values (_venue, _year, _type, _title) that a checker proposes for what the audit found; null without one."""
    asked = maintain.audit(entries, as_of_year).select("key", "field").distinct()
    proposed = provider.answer("check", asked) if provider else None
    if proposed is None:
        return None
    good = maintain.vetted(proposed, as_of_year).where("ok").groupBy("key").pivot("field", list(CORRECTED)).agg(F.first(F.trim("proposed")))
    return good.select("key", *[F.col(c).alias("_" + c) for c in CORRECTED])


def corrected(entries: DataFrame, fresh: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """All entries as fresh records and accepted corrections leave them, with ``changed``, how many values did."""
    mended = maintain.refreshed(entries, fresh).withColumn("changed", F.size("changes")).drop("changes")
    both = mended.unionByName(entries.join(mended.select("key"), "key", "left_anti").withColumn("changed", F.lit(0)))
    if good is None:
        return both
    rows = both.join(good, "key", "left")
    values = {c: F.coalesce(F.col("_" + c).cast(both.schema[c].dataType), F.col(c)) for c in CORRECTED}
    asked = sum((F.col("_" + c).isNotNull().cast("int") for c in CORRECTED), F.lit(0))
    return rows.withColumn("changed", F.col("changed") + asked).withColumns(values).select(*both.columns)


def check_entries(entries: DataFrame, fresh: DataFrame, as_of_year: int, *, fix: bool = False, provider: Provider | None = None) -> DataFrame:
    """key, before, after, status: findings of the audit, what fresh records mend and what a checker may correct."""
    both = corrected(entries, fresh, corrections(entries, as_of_year, provider))
    found = lambda rows, name: maintain.audit(rows, as_of_year).groupBy("key").agg(F.count("*").alias(name))
    rows = entries.select("key").join(found(entries, "_before"), "key", "left").join(found(both, "_after"), "key", "left").join(both.select("key", "changed"), "key", "left")
    b, a, n = F.coalesce("_before", F.lit(0)), F.coalesce("_after", F.lit(0)), F.coalesce("changed", F.lit(0))
    return rows.select("key", b.alias("before"), a.alias("after"), maintain.check_status(b, a, n, F.lit(False), fix).alias("status"))


def find_code(entries: DataFrame, links: DataFrame, *, force: bool = False, unofficial: bool = False) -> DataFrame:
    """key, code_url, status, reason of a search for repositories: found, unchanged, none, rejected or skipped.

    ``links`` (key, url, official, reachable, and perhaps confidence and evidence) is what the search found; an
    unreachable host says nothing, an absent page does. ``reason`` tells where a found link comes from.
    """
    more = {c: F.col(c) if c in links.columns else F.lit(None).cast("string") for c in ("confidence", "evidence")}
    l = links.select("key", normal_code_url(F.col("url")).alias("_url"), F.col("url").alias("_raw"), "official", "reachable", *[v.alias(c) for c, v in more.items()])
    rows = entries.select("key", "code_url").join(l, "key", "left")
    has = F.coalesce("code_url", F.lit("")) != ""
    status = (
        F.when(has & F.lit(not force), "skipped").when(F.coalesce("_raw", F.lit("")) == "", "none").when(F.col("_url").isNull() | (F.col("reachable") == "absent") | ~F.col("official") & F.lit(not unofficial), "rejected")
        .when(F.col("_url") == F.col("code_url"), "unchanged").otherwise("found")
    )
    return rows.select("key", F.when(status == "found", F.col("_url")).otherwise(F.col("code_url")).alias("code_url"), status.alias("status"), F.when(status == "found", code_reason(F.col("official"), F.col("confidence"), link_answer(F.col("reachable"))["doubt"], F.col("evidence"))).alias("reason"))


def identified(files: DataFrame, head_chars: int = 6000) -> DataFrame:
    """id, stem, doi, arxiv_id and title of dropped texts (id, stem, text), from their first page or so."""
    head = F.substring("text", 1, head_chars)
    stamp = F.coalesce(normal_arxiv(F.regexp_extract(head, r"(?i)arXiv:\s*(\S+)", 1)), normal_arxiv(F.regexp_extract(head, r"(?i)arxiv\.org/(?:abs|pdf)/(\S+)", 1)))
    # A bare F.trim would take the place of a line as the letters to trim.
    lines = F.transform(F.slice(F.split(head, "\n"), 1, 60), lambda x: F.trim(x))
    real = F.filter(lines, lambda x: F.length(x).between(8, 300) & x.rlike("[A-Za-z]{3}") & ~x.rlike(r"(?i)^(arxiv|preprint|published|under review|https?:|doi|vol\.|page|proceedings|copyright|©)"))
    return files.select("id", "stem", normal_doi(head).alias("doi"), stamp.alias("arxiv_id"), F.get(real, F.lit(0)).alias("title"))


def drain_inbox(files: DataFrame, entries: DataFrame) -> DataFrame:
    """id, key, how of dropped files; files that no entry matches are new works."""
    items = identified(files)
    return items.join(match_cascade(items, entries), "id", "left").withColumn("status", F.when(F.col("key").isNotNull(), "updated").otherwise("added"))


def grounded(quotes: Column, text: Column) -> Column:
    """Quotes that stand in the text, folded, at most QUOTES."""
    return F.slice(F.filter(quotes, lambda q: (folded(q) != "") & F.contains(folded(text), folded(q))), 1, QUOTES)


def ask(entries: DataFrame, question: str, fulltexts: DataFrame, provider: Provider, *, read: int = 5, pool: int = 30, **filters) -> DataFrame:
    """key, relevant, summary, quotes and outcome of the entries that may answer a question."""
    hits = search(entries.where("status in ('verified', 'unread')"), question, limit=pool, **filters).orderBy("score", "key").limit(read)
    rows = hits.join(fulltexts.select(F.col("doc").alias("key"), "text", "pages_read"), "key", "left")
    found = provider.answer("evidence", rows.select("key"))
    if found is None:
        return rows.select("key", F.lit(False).alias("relevant"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("quotes"), F.lit("unread").alias("outcome"))
    rows = rows.join(found.select("key", "relevant", "summary", F.col("quotes").alias("_quotes")), "key", "left").withColumn("quotes", grounded(F.col("_quotes"), F.col("text")))
    readable = usable(F.col("text"), F.col("pages_read"))
    outcome = F.when(~readable, "unreadable").when(~F.coalesce("relevant", F.lit(False)), "irrelevant").when(F.size("quotes") > 0, "cited").otherwise("empty")
    return rows.select("key", F.coalesce("relevant", F.lit(False)).alias("relevant"), "summary", F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"), outcome.alias("outcome"))


def answer_markdown(question: str, evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the question, a line for each quoted entry and a bibliography."""
    from quire.operators.export import citation

    rows = evidence.where("outcome = 'cited'").join(entries.select("key", citation(F.col("authors"), F.col("venue"), F.col("year")).alias("cite"), "title"), "key")
    ordered = F.array_sort(F.collect_list(F.struct("key", F.concat(F.lit("- "), F.coalesce("summary", F.lit("")), F.lit(" ["), F.col("key"), F.lit("]")).alias("line"), F.concat(F.lit("- ["), F.col("key"), F.lit("] "), F.col("title"), F.lit(" — "), F.col("cite")).alias("source"))))
    return rows.agg(F.concat_ws("\n", F.lit(f"# {question}\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n## Sources\n"), F.array_join(F.transform(ordered, lambda x: x["source"]), "\n")).alias("markdown"))


def trace_claim(starts: DataFrame, verdicts: DataFrame, *, max_hops: int = citations.MAX_HOPS) -> DataFrame:
    """start, hop, node, is_origin: back from each start along what readings blame, to the origin or the last readable work.

    ``verdicts`` (citing, cited, ord, confidence, states_claim, is_origin, readable, year, title, doi, arxiv_id) holds a
    reading of each work's references. Candidates are the three most confident; the origin is taken first, else the oldest.
    """
    near = citations.next_references(verdicts.withColumnRenamed("citing", "node")).withColumnRenamed("node", "citing").where("readable and states_claim")
    order = [F.col("is_origin").desc(), F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)), F.col("ord")]
    walk = citations.chains(starts, near, order, max_hops=max_hops)
    origin = near.where("is_origin").select(F.col("cited").alias("node"), F.lit(True).alias("_origin")).distinct()
    last = walk.groupBy("start").agg(F.max("hop").alias("_last"))
    rows = walk.join(origin, "node", "left").join(last, "start")
    return rows.select("start", "hop", "node", (F.coalesce("_origin", F.lit(False)) | (F.col("hop") == F.col("_last"))).alias("is_origin"))
