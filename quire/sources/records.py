"""Records of bibliographic indexes as rows: the normalisers of three JSON and XML shapes, and provider tables.

Each takes a DataFrame with ``work`` and ``payload`` (the index's answer as text) and gives rows of ``schema.RECORD``.
Payloads are parsed by Spark's own JSON and XML expressions, so a stored crawl of any size can be normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.identifiers import author_name, normal_arxiv, normal_doi, pmcid
from quire.functions.venues import clean_venue, is_workshop, let, without_tags
from quire.schema import REFERENCE

# Types of the two JSON indexes, and those for which the publisher is the venue.
CROSSREF_TYPES = {"journal-article": "journal article", "posted-content": "preprint", "book": "book", "monograph": "book", "book-chapter": "book chapter", "dissertation": "thesis", "report": "report"}
BOOKISH = ("book", "monograph", "book-chapter", "book-part", "book-section", "book-series", "book-set", "edited-book", "reference-book")
TITLE_CHARS, REFERENCE_AUTHORS = 400, 5
CROSSREF = """struct<title: array<string>, author: array<struct<given: string, family: string, name: string>>, DOI: string, `container-title`: array<string>, publisher: string,
type: string, URL: string, `is-referenced-by-count`: bigint, abstract: string, `published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>,
issued: struct<`date-parts`: array<array<int>>>, created: struct<`date-parts`: array<array<int>>>,
reference: array<struct<`article-title`: string, `volume-title`: string, unstructured: string, year: string, DOI: string>>>""".replace("\n", " ")
S2 = """struct<title: string, authors: array<struct<name: string>>, year: int, venue: string, citationCount: bigint, abstract: string, externalIds: struct<DOI: string, ArXiv: string, PubMedCentral: string>,
openAccessPdf: struct<url: string>, publicationTypes: array<string>,
references: array<struct<title: string, year: int, externalIds: struct<DOI: string, ArXiv: string>, authors: array<struct<name: string>>>>>""".replace("\n", " ")
ARXIV = "struct<id: array<string>, title: array<string>, author: array<struct<name: array<string>>>, published: array<string>, journal_ref: array<string>, doi: array<string>, summary: array<string>>"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _crossref_year(m: Column) -> Column:
    year = lambda name: F.nullif(F.get(F.get(m[name]["date-parts"], F.lit(0)), F.lit(0)), F.lit(0))
    return F.coalesce(*[year(n) for n in ("published-print", "published-online", "issued", "created")])


def crossref_type(kind: Column, venue: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    names = F.create_map(*[F.lit(x) for p in CROSSREF_TYPES.items() for x in p])
    return F.when(k == "proceedings-article", F.when(is_workshop(venue), "workshop paper").otherwise("conference paper")).otherwise(F.coalesce(F.try_element_at(names, k), F.lit("other")))


def s2_type(kinds: Column, venue: Column) -> Column:
    k = F.transform(F.coalesce(kinds, F.array().cast("array<string>")), F.lower)
    has = lambda x: F.array_contains(k, x)
    return F.when(has("conference"), F.when(is_workshop(venue), "workshop paper").otherwise("conference paper")).when(has("journalarticle"), "journal article").when(has("book"), "book").when(has("review"), "journal article").otherwise("other")


def _references(refs: Column, title, year, doi, arxiv, authors) -> Column:
    made = F.transform(refs, lambda r: F.struct(F.substring(title(r), 1, TITLE_CHARS).alias("title"), year(r).alias("year"), normal_doi(doi(r)).alias("doi"), arxiv(r).alias("arxiv_id"), authors(r).alias("authors"), F.lit(None).cast("string").alias("key")))
    return F.coalesce(F.filter(made, lambda r: F.coalesce(r["title"], F.lit("")) != ""), F.array().cast(f"array<{REFERENCE}>"))


def from_crossref(answers: DataFrame, priority: int = 1) -> DataFrame:
    rows = answers.withColumn("m", F.from_json(F.get_json_object("payload", "$.message"), CROSSREF)).where("m is not null")
    m, none = F.col("m"), F.lit(None).cast("string")
    container = clean_venue(F.get(m["container-title"], F.lit(0)))
    rows = rows.withColumn("venue", F.coalesce(container, F.when(F.lower(m["type"]).isin(*BOOKISH), clean_venue(m["publisher"]))))
    authors = F.filter(F.transform(m["author"], lambda a: author_name(F.when(F.coalesce(a["family"], F.lit("")) != "", a["given"]), a["family"], a["name"])), lambda a: F.coalesce(a, F.lit("")) != "")
    refs = _references(m["reference"], lambda r: F.coalesce(F.nullif(r["article-title"], F.lit("")), F.nullif(r["volume-title"], F.lit("")), r["unstructured"]), lambda r: F.substring(r["year"], 1, 4).try_cast("int"), lambda r: r["DOI"], lambda r: none, lambda r: F.array().cast("array<string>"))
    return rows.select(
        "work", F.lit(priority).alias("priority"), F.get(m["title"], F.lit(0)).alias("title"), authors.alias("authors"), _crossref_year(m).alias("year"), "venue", crossref_type(m["type"], F.col("venue")).alias("type"), normal_doi(m["DOI"]).alias("doi"),
        none.alias("arxiv_id"), m["URL"].alias("url"), none.alias("pdf_url"), none.alias("pmcid"), without_tags(F.coalesce(m["abstract"], F.lit(""))).alias("abstract"), m["is-referenced-by-count"].alias("citation_count"), none.alias("bibtex"),
        refs.alias("references"), F.lit("crossref").alias("source"), F.lit(False).alias("title_matched"),
    )


def from_semantic_scholar(answers: DataFrame, priority: int = 2, title_matched: bool = False) -> DataFrame:
    rows = answers.withColumn("m", F.from_json("payload", S2)).where("coalesce(m.title, '') <> ''").withColumn("venue", clean_venue(F.col("m.venue")))
    m, none = F.col("m"), F.lit(None).cast("string")
    names = lambda a: F.filter(F.transform(a, lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    arxiv = normal_arxiv(m["externalIds"]["ArXiv"])
    refs = _references(m["references"], lambda r: collapsed(r["title"]), lambda r: r["year"], lambda r: r["externalIds"]["DOI"], lambda r: normal_arxiv(r["externalIds"]["ArXiv"]), lambda r: F.coalesce(F.slice(names(r["authors"]), 1, REFERENCE_AUTHORS), F.array().cast("array<string>")))
    return rows.select(
        "work", F.lit(priority).alias("priority"), collapsed(m["title"]).alias("title"), names(m["authors"]).alias("authors"), m["year"].alias("year"), "venue", s2_type(m["publicationTypes"], F.col("venue")).alias("type"), normal_doi(m["externalIds"]["DOI"]).alias("doi"),
        arxiv.alias("arxiv_id"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv).alias("url"), F.nullif(m["openAccessPdf"]["url"], F.lit("")).alias("pdf_url"), pmcid(m["externalIds"]["PubMedCentral"]).alias("pmcid"), collapsed(m["abstract"]).alias("abstract"),
        m["citationCount"].alias("citation_count"), none.alias("bibtex"), refs.alias("references"), F.lit("semanticscholar").alias("source"), F.lit(title_matched).alias("title_matched"),
    )


def from_arxiv(answers: DataFrame, priority: int = 0) -> DataFrame:
    """Atom entries, one ``<entry>`` element a payload; a payload that holds none gives no row."""
    bare = F.regexp_replace(F.regexp_replace("payload", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    entry = F.regexp_extract(bare, r"(?s)<entry[\s>].*?</entry\s*>", 0)
    # A payload is parsed once: what a generator gives, no filter and no projection computes again.
    rows = answers.select("work", entry.alias("_x")).select("work", "_x", F.inline(F.array(F.from_xml("_x", ARXIV))))
    # A field with markup inside, or with an escaped less-than sign, is read by its path.
    x = lambda name: F.when(F.contains(F.get(name, F.lit(0)), F.lit("<")), F.xpath_string("_x", F.lit(f"/entry/{name}"))).otherwise(F.coalesce(F.get(name, F.lit(0)), F.lit("")))
    names = F.flatten(F.filter(F.transform("author", lambda a: a["name"]), lambda n: n.isNotNull()))
    names = F.when(F.exists(names, lambda n: F.contains(n, F.lit("<"))), F.xpath("_x", F.lit("/entry/author/name/text()"))).otherwise(F.coalesce(names, F.array().cast("array<string>")))
    rows = rows.withColumn("arxiv_id", F.coalesce(normal_arxiv(x("id")), F.col("work"))).withColumn("title", collapsed(x("title"))).where("title <> '' and arxiv_id <> ''")
    none = F.lit(None).cast("string")
    authors = F.filter(F.transform(names, collapsed), lambda a: a != "")
    return rows.select(
        "work", F.lit(priority).alias("priority"), "title", authors.alias("authors"), F.substring(x("published"), 1, 4).try_cast("int").alias("year"), let(F.nullif(x("journal_ref"), F.lit("")), clean_venue).alias("venue"), F.lit("preprint").alias("type"),
        normal_doi(x("doi")).alias("doi"), "arxiv_id", F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")).alias("url"), F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id")).alias("pdf_url"), none.alias("pmcid"),
        collapsed(x("summary")).alias("abstract"), F.lit(None).cast("bigint").alias("citation_count"), none.alias("bibtex"), F.array().cast(f"array<{REFERENCE}>").alias("references"), F.lit("arxiv").alias("source"), F.lit(False).alias("title_matched"),
    )


def supplementary(records: DataFrame) -> DataFrame:
    """Title matches without their identity: they say how a work fares, not which it is."""
    return records.withColumns({c: F.when(~F.col("title_matched"), F.col(c)) for c in ("doi", "arxiv_id", "url", "pdf_url", "bibtex")})


def pdf_candidates(rows: DataFrame) -> DataFrame:
    """work, place, url, label: where a work's PDF may be, in order, each URL once."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    options = F.array(
        F.struct(F.concat(F.lit("https://arxiv.org/pdf/"), some("arxiv_id")).alias("url"), F.lit("arxiv").alias("label")), F.struct(some("pdf_url").alias("url"), F.lit("open access").alias("label")),
        F.struct(F.concat(F.lit("https://europepmc.org/articles/"), some("pmcid"), F.lit("?pdf=render")).alias("url"), F.lit("europepmc").alias("label")), F.struct(F.when(F.col("url").rlike(r"(?i)\.pdf($|[?#])"), F.col("url")).alias("url"), F.lit("landing page").alias("label")),
    )
    rows = rows.select("work", F.posexplode(F.filter(options, lambda o: o["url"].isNotNull())).alias("place", "o")).select("work", "place", "o.url", "o.label")
    return rows.groupBy("work", "url").agg(F.min(F.struct("place", "label")).alias("m")).select("work", F.col("m.place").alias("place"), "url", F.col("m.label").alias("label"))


def html_candidates(rows: DataFrame) -> DataFrame:
    """work, place, url, label of readable pages."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    options = F.array(
        F.struct(F.concat(F.lit("https://arxiv.org/html/"), some("arxiv_id"), F.lit("v1")).alias("url"), F.lit("arxiv html").alias("label")), F.struct(F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), some("arxiv_id")).alias("url"), F.lit("ar5iv").alias("label")),
        F.struct(F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), some("pmcid"), F.lit("/fullTextXML")).alias("url"), F.lit("europepmc xml").alias("label")), F.struct(some("url").alias("url"), F.lit("landing page").alias("label")),
    )
    return rows.select("work", F.posexplode(F.filter(options, lambda o: o["url"].isNotNull())).alias("place", "o")).select("work", "place", "o.url", "o.label")


def embedded_pdf(html: Column) -> Column:
    """The first frame, embed or link target of a page that names a PDF."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (r"""(?i)<iframe[^>]+src=["']([^"']+)""", r"""(?i)<embed[^>]+src=["']([^"']+)""", r"""(?i)href=["']([^"']+)""")])
    return F.get(F.filter(found, lambda u: F.contains(F.lower(u), F.lit(".pdf"))), F.lit(0))


def best_full_text(attempts: DataFrame) -> DataFrame:
    """One usable text a document from attempts (doc, priority, source, text, pages, pages_read): the first by priority."""
    from quire.functions.documents import usable

    good = attempts.where(usable(F.col("text"), F.col("pages_read")))
    return good.groupBy("doc").agg(F.min_by(F.struct("source", "text", "pages", "pages_read"), "priority").alias("t")).select("doc", "t.*")


def looked_up(candidates: DataFrame, catalog: DataFrame, ident: str = "ident") -> DataFrame:
    """A batch lookup: candidates with the record of their identifier; absent ones have nulls."""
    return candidates.join(catalog, candidates[ident] == catalog["work"], "left")


def searched(catalog: DataFrame, terms: list[str], *, facet: str = "relevance", limit: int = 10, low: int | None = None, high: int | None = None, as_of_year: int = 2026) -> DataFrame:
    """A facet of an index: works whose title holds a term, by hits, citations or year."""
    hits = sum((F.lower("title").contains(t.lower()).cast("int") for t in terms), F.lit(0))
    rows = catalog.withColumn("hits", hits).where("hits > 0")
    if low or facet == "recent":
        rows = rows.where(F.col("year") >= max(low or 0, as_of_year - 2 if facet == "recent" else 0))
    if high:
        rows = rows.where(F.col("year") <= high)
    if facet == "preprints":
        rows = rows.where("type = 'preprint'")
    if facet == "surveys":
        rows = rows.where(F.lower("title").rlike(r"\b(survey|review|overview)\b"))
    first = [F.coalesce("citation_count", F.lit(0)).desc()] if facet == "foundational" else [F.col("hits").desc(), F.coalesce("citation_count", F.lit(0)).desc()]
    return rows.orderBy(*first, "work").limit(limit)


def combined_search(primary: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The first index's hits, filled up with the second's whose DOI is new."""
    new = second.join(primary.select("doi").where("doi is not null").distinct(), "doi", "left_anti")
    rows = primary.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return rows.orderBy("_s", "place").drop("_s").limit(limit)


def venue_of(record: Column) -> Column:
    return let(record["venue"], clean_venue)
