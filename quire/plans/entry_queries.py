"""Registered queries of the operators on entries, records and readings, each beside the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import documents as texts
from quire.functions import identifiers, venues
from quire.operators import actions, citations, export, maintain, ranking
from quire.plans import providers
from quire.plans.tables import ENTRIES, entries, query
from quire.plans.tables import table as _t
from quire.sources import records

#: White space as Unicode has it, for the SQL.
_SPACE = r"[\x09-\x0D \x{85}\p{Z}]+"
_CITED = "\n".join(f"[{i}] Lee et al. A study of things. In Proceedings, 2001." for i in range(1, 7))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _text(column: str):
    return F.col(column).cast("string")


def _digest(column):
    return F.md5(column.cast("binary"))


# -- texts ---------------------------------------------------------------------------------------------------


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT *, array_to_string(w[1:40], ' ') AS h FROM w), e AS (SELECT *, regexp_extract(h, '(?s)^.*\.') AS e FROM h)
SELECT doc_id, CASE WHEN len(w) <= 40 THEN array_to_string(w, ' ') WHEN length(e) > 0.5 * length(h) THEN e ELSE rtrim(h, ',;: ') || '…' END AS clipped FROM e"""
)
def clipped_words(spark, sf_dir):
    """Texts cut to forty words, at a sentence end where one lies past the middle."""
    return _t(spark, sf_dir, "documents").select("doc_id", texts.clip_words(F.col("text"), 40).alias("clipped"))


@query(
    rf"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS f FROM documents), a AS (SELECT *, regexp_replace(substr(f, 1, 180), '\s+\S*$', '') AS a FROM f)
SELECT doc_id, CASE WHEN length(f) <= 180 THEN f ELSE rtrim(CASE WHEN length(a) > 108 THEN a ELSE substr(f, 1, 180) END, ' ') || '…' END AS snippet FROM a"""
)
def text_snippets(spark, sf_dir):
    """One line of at most 180 characters of each text."""
    return _t(spark, sf_dir, "documents").select("doc_id", texts.snippet(F.col("text"), 180).alias("snippet"))


_BARE = r"regexp_replace(coalesce(text, ''), '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+$', '')"


def _bare():
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+$", "")


@query(
    f"""WITH b AS (SELECT doc_id, {_BARE} AS b FROM documents), f AS (SELECT *, b || chr(10) || 'References' || chr(10) || {_sql_text(_CITED)} AS f FROM b)
SELECT doc_id, md5(CASE WHEN b <> '' AND length(b) + 1 >= 0.05 * length(f) THEN b || chr(10) || chr(10) || '[... reference list omitted ...]' ELSE f END) AS digest FROM f"""
)
def references_cut(spark, sf_dir):
    """Texts with a reference list at the end, which goes unless it starts too early; a digest of each."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(_bare(), F.lit("\nReferences\n" + _CITED)).alias("text"))
    return texts.strip_back_matter(d, appendix=False).select("doc_id", _digest(F.col("text")).alias("digest"))


@query(
    f"""WITH b AS (SELECT doc_id, {_BARE} AS b FROM documents), f AS (SELECT *, b || chr(10) || 'Appendix A: Proofs' || chr(10) || 'More.' AS f FROM b)
SELECT doc_id, md5(CASE WHEN length(b) + 1 >= floor(0.2 * length(f)) THEN b || chr(10) || chr(10) || '[... appendix omitted ...]' ELSE f END) AS digest FROM f"""
)
def appendix_cut(spark, sf_dir):
    """Texts with an appendix, which goes unless it starts in the first fifth; a digest of each."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(_bare(), F.lit("\nAppendix A: Proofs\nMore.")).alias("text"))
    return texts.strip_back_matter(d, references=False).select("doc_id", _digest(F.col("text")).alias("digest"))


@query(
    r"""WITH f AS (SELECT conv_id, list_filter(list_transform(list(text ORDER BY turn, text), lambda v: trim(regexp_replace(v, '[\x09-\x0D ]+', ' ', 'g'))), lambda v: length(v) >= 20) AS f FROM conversations GROUP BY conv_id),
l AS (SELECT *, list_transform(f, lambda v: lower(v)) AS l FROM f)
SELECT conv_id, array_to_string(list_filter(f, lambda v, i: list_position(l, lower(v)) = i)[1:5], chr(10)) AS strings FROM l"""
)
def clean_strings(spark, sf_dir):
    """The first five different turns of at least twenty characters of each conversation."""
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("v"))
    return c.select("conv_id", F.array_join(identifiers.clean_strings(F.col("v"), 5, 20), "\n").alias("strings"))


@query(
    r"""WITH h AS (SELECT doc_id, substr('arXiv:' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '.00042v1 [cs]' || chr(10) || text, 1, 6000) AS h FROM documents),
l AS (SELECT *, list_transform(string_split(h, chr(10))[1:60], lambda x: trim(x, ' ')) AS l FROM h)
SELECT doc_id AS id, nullif(regexp_replace(lower(regexp_extract(h, '(?i)10\.\d{4,9}/[-._;()/:a-z0-9<>\[\]]+')), '[.,;)]+$', ''), '') AS doi, CASE WHEN h IS NOT NULL THEN lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '.00042' END AS arxiv_id,
list_filter(l, lambda x: length(x) BETWEEN 8 AND 300 AND regexp_matches(x, '[A-Za-z]{3}') AND NOT regexp_matches(x, '(?i)^(arxiv|preprint|published|under review|https?:|doi|vol\.|page|proceedings|copyright|©)'))[1] AS title FROM l"""
)
def identified_files(spark, sf_dir):
    """What dropped texts say of themselves: stamp, DOI and title. The first 6000 characters are the rule's own limit."""
    stamp = F.concat(F.lit("arXiv:"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(".00042v1 [cs]\n"))
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("stem"), F.concat(stamp, "text").alias("text"))
    return actions.identified(files).drop("stem")


# -- records -------------------------------------------------------------------------------------------------

_PART_KIND = "CASE p_size % 4 WHEN 0 THEN 'journal article' WHEN 1 THEN 'conference paper' WHEN 2 THEN 'preprint' ELSE 'other' END"


@query(
    f"""SELECT CAST(p_partkey AS VARCHAR) AS work, p_name AS title, 'Ann L' || p_partkey || '; The Group' AS authors, CASE WHEN p_size % 5 > 0 THEN CAST(1990 + p_size % 20 AS INTEGER) ELSE 2004 END AS year, CASE WHEN p_size % 3 > 0 THEN 'Proc. ICML' END AS venue,
{_PART_KIND} AS type, '10.1000/x' || p_partkey AS doi, CAST(p_size AS BIGINT) AS citation_count, 'A & B' AS abstract, 'Ref ' || p_partkey || '|1999|10.5000/r' AS reference FROM part"""
)
def records_crossref(spark, sf_dir):
    """The first index's JSON as records."""
    k, size = _text("p_partkey"), F.col("p_size")
    kind = F.get(F.array(*[F.lit(x) for x in ("journal-article", "proceedings-article", "posted-content", "unheard-of")]), size % 4)
    dates = lambda y: F.struct(F.array(F.array(y.cast("int"))).alias("date-parts"))
    none = F.lit(None).cast("string")
    message = F.struct(
        F.array("p_name").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.concat(F.lit("L"), k).alias("family"), none.alias("name")), F.struct(none.alias("given"), none.alias("family"), F.lit("The Group").alias("name"))).alias("author"),
        F.concat(F.lit("https://doi.org/10.1000/X"), k).alias("DOI"), F.array(F.when(size % 3 > 0, "<i>Proc. ICML</i>;").otherwise("n/a")).alias("container-title"), F.lit("Elsevier BV").alias("publisher"), kind.alias("type"), size.alias("is-referenced-by-count"),
        F.lit("<p>A &amp;amp; B</p>").alias("abstract"), dates(F.when(size % 5 > 0, 1990 + size % 20)).alias("issued"), dates(F.lit(2004)).alias("created"),
        F.array(F.struct(F.concat(F.lit("Ref "), k).alias("unstructured"), F.lit("1999a").alias("year"), F.lit("10.5000/R.").alias("DOI")), F.struct(F.lit("").alias("unstructured"), none.alias("year"), none.alias("DOI"))).alias("reference"),
    )
    answers = _t(spark, sf_dir, "part").select(k.alias("work"), F.to_json(F.struct(message.alias("message"))).alias("payload"))
    shown = F.array_join(F.transform("references", lambda r: F.concat_ws("|", r["title"], r["year"].cast("string"), r["doi"])), ";")
    return records.from_crossref(answers).select("work", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "type", "doi", "citation_count", "abstract", shown.alias("reference"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS work, p_name AS title, 'Ann Lee' AS authors, p_size AS year, CASE p_size % 4 WHEN 0 THEN 'workshop paper' WHEN 1 THEN 'journal article' WHEN 2 THEN 'book' ELSE 'other' END AS type, '10.1000/x' || p_partkey AS doi,
lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.00001' AS arxiv_id, 'https://arxiv.org/abs/' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.00001' AS url, CASE WHEN p_size % 2 = 0 THEN 'PMC' || p_partkey END AS pmcid, CAST(p_size AS BIGINT) AS citation_count FROM part WHERE p_name <> ''"""
)
def records_semantic_scholar(spark, sf_dir):
    """The second index's JSON as records."""
    k, size = _text("p_partkey"), F.col("p_size")
    kinds = F.get(F.array(*[F.array(F.lit(x)) for x in ("Conference", "JournalArticle", "Book", "Dataset")]), size % 4)
    ids = F.struct(F.concat(F.lit("10.1000/X"), k).alias("DOI"), F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit(".00001v3")).alias("ArXiv"), F.when(size % 2 == 0, F.concat(F.lit("id PMC"), k)).otherwise("none").alias("PubMedCentral"))
    payload = F.struct(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("title"), F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), size.alias("year"), F.lit("ICML Workshop").alias("venue"), size.alias("citationCount"), ids.alias("externalIds"), kinds.alias("publicationTypes"))
    answers = _t(spark, sf_dir, "part").select(k.alias("work"), F.to_json(payload).alias("payload"))
    return records.from_semantic_scholar(answers).select("work", "title", F.array_join("authors", "; ").alias("authors"), "year", "type", "doi", "arxiv_id", "url", "pmcid", "citation_count")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS work, p_name AS title, 'Ann Lee; Bo Li' AS authors, CAST(1990 + p_size AS INTEGER) AS year, CASE WHEN p_size % 2 = 0 THEN p_brand END AS venue, '10.1000/x' || p_partkey AS doi,
lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.00007' AS arxiv_id, 'https://arxiv.org/pdf/' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.00007' AS pdf_url FROM part"""
)
def records_arxiv(spark, sf_dir):
    """The third index's Atom entries as records."""
    k, number = _text("p_partkey"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    xml = F.concat(
        F.lit('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/'), number, F.lit(".00007v2</id><title>\n "), F.replace("p_name", F.lit(" "), F.lit("\n  ")),
        F.lit("</title><author><name>Ann  Lee</name></author><author><name>Bo Li</name></author><published>"), (1990 + F.col("p_size")).cast("string"), F.lit("-05-01T00:00:00Z</published>"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<arxiv:journal_ref>"), F.col("p_brand"), F.lit(".</arxiv:journal_ref>"))).otherwise(""), F.lit("<arxiv:doi>10.1000/X"), k, F.lit("</arxiv:doi></entry>"),
    )
    # The table is a small file of many rows, whose payloads are dear to parse: more tasks than it has splits.
    parts = _t(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    return records.from_arxiv(parts.select(k.alias("work"), xml.alias("payload"))).select("work", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", "arxiv_id", "pdf_url")


@query(
    """WITH r AS (SELECT p_partkey AS work, 0 AS priority, 'arxiv' AS source, CASE WHEN p_size % 3 > 0 THEN p_name ELSE '' END AS title, NULL AS doi, 'a' || p_partkey AS arxiv_id, NULL AS venue, 'preprint' AS type, NULL AS year, CAST(NULL AS BIGINT) AS cites, false AS tm, 0 AS refs FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 1, 'crossref', p_brand, '10.1/' || p_partkey, NULL, CASE WHEN p_size % 4 = 0 THEN 'Elsevier BV' ELSE 'KDD' END, 'other', CASE WHEN p_size % 5 > 0 THEN 1990 + p_size END, p_size, false, p_size % 3 FROM part
UNION ALL SELECT p_partkey, 2, 's2', p_type, '10.2/' || p_partkey, 'b' || p_partkey, 'ICML', 'journal article', 2001, 2 * (p_size % 9), true, 1 FROM part)
SELECT work, arg_min(title, priority) FILTER (title <> '') AS title, arg_min(doi, priority) FILTER (doi IS NOT NULL AND NOT tm) AS doi, arg_min(arxiv_id, priority) FILTER (arxiv_id IS NOT NULL AND NOT tm) AS arxiv_id,
arg_min(venue, CASE WHEN venue = 'Elsevier BV' THEN 10 ELSE 0 END + priority) FILTER (venue IS NOT NULL) AS venue, coalesce(arg_min(type, priority) FILTER (type <> 'other'), 'other') AS type, CAST(arg_min(year, priority) FILTER (year IS NOT NULL) AS INTEGER) AS year,
max(cites) AS citation_count, CAST(max(refs) AS INTEGER) AS n_references, string_agg(source, ',' ORDER BY priority) AS sources FROM r GROUP BY work"""
)
def merged_records(spark, sf_dir):
    """Records of three indexes merged by priority; a title match gives no identity, a publisher is no venue."""
    p, k, size, none = _t(spark, sf_dir, "part"), _text("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    plain = {c: none for c in ("url", "abstract", "pdf_url", "pmcid", "bibtex", "doi", "arxiv_id", "venue")}

    def source(rows, priority, name, title, kind, year, cites, references, matched=False, **more):
        fields = plain | more | {"title": title, "type": F.lit(kind), "year": year.cast("int"), "citation_count": cites.cast("bigint"), "authors": F.array(F.lit("Ann Lee")), "title_matched": F.lit(matched)}
        refs = F.slice(F.array(*[F.struct(F.lit(f"r{i}").alias("title")) for i in range(3)]), F.lit(1), references)
        return rows.select(F.col("p_partkey").alias("work"), F.lit(priority).alias("priority"), F.lit(name).alias("source"), refs.alias("references"), *[v.alias(c) for c, v in sorted(fields.items())])

    a = source(p.where("p_size % 2 = 0"), 0, "arxiv", F.when(size % 3 > 0, F.col("p_name")).otherwise(""), "preprint", F.lit(None), F.lit(None), F.lit(0), arxiv_id=F.concat(F.lit("a"), k))
    b = source(p, 1, "crossref", F.col("p_brand"), "other", F.when(size % 5 > 0, 1990 + size), size, size % 3, doi=F.concat(F.lit("10.1/"), k), venue=F.when(size % 4 == 0, "Elsevier BV").otherwise("KDD"))
    c = source(p, 2, "s2", F.col("p_type"), "journal article", F.lit(2001), 2 * (size % 9), F.lit(1), True, doi=F.concat(F.lit("10.2/"), k), arxiv_id=F.concat(F.lit("b"), k), venue=F.lit("ICML"))
    out = maintain.merged_records(a.unionByName(b).unionByName(c))
    return out.select("work", "title", "doi", "arxiv_id", "venue", "type", "year", "citation_count", F.size("references").alias("n_references"), F.array_join("sources", ",").alias("sources"))


@query(
    """WITH u AS (SELECT p_partkey AS work, unnest([{'place': 0, 'url': CASE WHEN p_size % 2 = 0 THEN 'https://arxiv.org/pdf/' || p_size || '.1' END, 'label': 'arxiv'}, {'place': 1, 'url': CASE WHEN p_size % 3 = 0 THEN 'https://oa.example/' || p_partkey || '.pdf' END, 'label': 'open access'},
{'place': 2, 'url': CASE WHEN p_size % 5 = 0 THEN 'https://europepmc.org/articles/PMC' || p_partkey || '?pdf=render' END, 'label': 'europepmc'}, {'place': 3, 'url': CASE WHEN p_size % 7 = 0 THEN 'https://oa.example/' || p_partkey || '.pdf' END, 'label': 'landing page'}]) AS o FROM part)
SELECT work, o.url AS url, arg_min(o.label, o.place) AS label FROM u WHERE o.url IS NOT NULL GROUP BY work, o.url"""
)
def pdf_places(spark, sf_dir):
    """Where a work's PDF may be, each URL once."""
    k, size = _text("p_partkey"), F.col("p_size")
    pdf = F.concat(F.lit("https://oa.example/"), k, F.lit(".pdf"))
    rows = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("work"), F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(".1"))).alias("arxiv_id"), F.when(size % 3 == 0, pdf).otherwise("").alias("pdf_url"), F.when(size % 5 == 0, F.concat(F.lit("PMC"), k)).alias("pmcid"), F.when(size % 7 == 0, pdf).otherwise("https://oa.example/page").alias("url"),
    )
    return records.pdf_candidates(rows).select("work", "url", "label")


# -- entries -------------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'verified' ELSE 'unread' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'old line' ELSE 'new line' END AS one_liner,
CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/new/' || c_custkey WHEN c_custkey % 2 = 0 THEN 'https://github.com/old/' || c_custkey END AS code_url, CASE WHEN c_custkey % 3 = 0 THEN 'web' WHEN c_custkey % 2 = 0 THEN 'paper' END AS code_source FROM customer"""
)
def carried_reading(spark, sf_dir):
    """Replaced entries keep the reading and code link of those that were read."""
    k, none = F.col("c_custkey"), F.lit(None)
    link = lambda who: F.concat(F.lit(f"https://github.com/{who}/"), k.cast("string"))
    made = lambda line, status, url, source: [k.alias("key"), F.lit(line).alias("one_liner"), F.array().cast("array<string>").alias("sections"), F.array().cast("array<string>").alias("key_findings"), F.lit("pdf").alias("read_source"), none.cast("bigint").alias("text_chars"), none.cast("int").alias("pages"), none.cast("int").alias("pages_read"), status.alias("status"), url.alias("code_url"), source.alias("code_source")]
    customer = _t(spark, sf_dir, "customer")
    new = customer.select(*made("new line", F.lit("unread"), F.when(k % 3 == 0, link("new")), F.when(k % 3 == 0, "web")))
    old = customer.where(k % 2 == 0).select(*made("old line", F.when(k % 4 == 0, "verified").otherwise("unread"), link("old"), F.lit("paper")))
    return maintain.carried_reading(new, old).select("key", "status", "one_liner", "code_url", "code_source")


@query(
    """WITH d AS (SELECT doc_id, substr(lower(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '', 'g')), 1, 200) AS s FROM documents),
l AS (SELECT s, min('lib' || (doc_id % 3) || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS f FROM d WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0 AND s <> '' GROUP BY s)
SELECT doc_id AS id, split_part(f, '/', 1) AS library, split_part(f, '/', 2) AS key FROM d JOIN l USING (s)"""
)
def reading_elsewhere(spark, sf_dir):
    """Readings of the same titles in sibling libraries, the first in library order."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    d = _t(spark, sf_dir, "documents").withColumns({"title": F.regexp_replace(F.substring_index("text", "\n", 1), "[^\\x00-\\x7F]", ""), "doi": none, "arxiv_id": none})
    read = d.select(F.concat(F.lit("lib"), (i % 3).cast("string")).alias("library"), F.lpad(i.cast("string"), 12, "0").alias("key"), "title", "doi", "arxiv_id", F.when(i % 2 == 0, "verified").otherwise("unread").alias("status"), F.when(i % 5 == 0, "").otherwise("read").alias("one_liner"))
    return maintain.reading_elsewhere(d.select(i.alias("id"), "doi", "arxiv_id", "title"), read, "lib0")


@query(
    """SELECT c_custkey AS key, field, CASE WHEN proposed = '' THEN 'nothing was proposed' WHEN c_custkey % 11 = 0 THEN 'no source was given' WHEN field = 'venue' AND proposed = 'Elsevier BV' THEN 'not a venue' WHEN field = 'year' AND proposed <> '2001' THEN 'not a plausible year'
WHEN field = 'doi' THEN 'not a field that may be corrected' END AS why FROM (SELECT c_custkey, ['venue', 'year', 'type', 'title', 'doi'][1 + c_custkey % 5] AS field, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ICML' ELSE 'Elsevier BV' END WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '3001' ELSE '2001' END ELSE 'text' END END AS proposed FROM customer)"""
)
def vetted_corrections(spark, sf_dir):
    """Corrections of a checker and why some are refused."""
    k = F.col("c_custkey")
    field = F.get(F.array(*[F.lit(x) for x in ("venue", "year", "type", "title", "doi")]), (k % 5).cast("int"))
    value = F.when(k % 7 == 0, " ").when(k % 5 == 0, F.when(k % 2 == 0, "ICML").otherwise("Elsevier BV")).when(k % 5 == 1, F.when(k % 2 == 0, "3001").otherwise(" 2001")).otherwise("text")
    rows = _t(spark, sf_dir, "customer").select(k.alias("key"), field.alias("field"), value.alias("proposed"), F.when(k % 11 == 0, "").otherwise("index").alias("source"))
    return maintain.vetted(rows, 2002).select("key", "field", "why")


@query(
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 5 <> 1 THEN 'rejected' WHEN o_orderkey % 6 = 0 THEN 'unchanged' ELSE 'found' END AS status,
CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 1 THEN 'https://github.com/acme/r' || o_orderkey END AS code_url FROM orders"""
)
def code_links(spark, sf_dir):
    """What a search for repositories changes: unofficial, vanished and ownerless links are refused."""
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 5
    repo = F.concat(F.lit("https://github.com/acme/r"), k.cast("string"))
    o = _t(spark, sf_dir, "orders")
    url = F.when(kind == 0, "").when(kind == 2, "github.com/acme").otherwise(F.concat(repo, F.lit("/.")))
    links = o.select(k.alias("key"), url.alias("url"), (kind != 3).alias("official"), F.when(kind == 4, "absent").otherwise("unknown").alias("reachable"))
    return actions.find_code(o.select(k.alias("key"), F.when(k % 6 == 0, repo).alias("code_url")), links, force=True).select("key", "code_url", "status")


@query("SELECT event_id AS key, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM events WHERE event_id % 7 = 0 OR event_id % 11 <> 0")
def index_after_sync(spark, sf_dir):
    """The index once changed, new and vanished rows are taken in."""
    e, k = _t(spark, sf_dir, "events"), F.col("event_id")
    old = e.where(k % 7 != 0).select(k.alias("key"), F.col("value").alias("mtime"), F.lit("old").alias("state"))
    new = e.where((k % 11 != 0) | (k % 7 == 0)).select(k.alias("key"), (F.col("value") + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("mtime"), F.lit("new").alias("state"))
    return maintain.applied_diff(old, new, maintain.snapshot_diff(old, new)).select("key", "state")


@query(f"SELECT count(*) AS entries, CAST(sum(citation_count % 3) AS BIGINT) AS references, min(year) AS first_year, max(year) AS last_year FROM ({ENTRIES})")
def library_totals(spark, sf_dir):
    """Entries, references and the span of years."""
    e = entries(spark, sf_dir)
    return maintain.library_totals(e.withColumn("references", F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("citation_count") % 3).cast("int"))))


@query(f"SELECT level, count(*) AS n FROM ({ENTRIES}) GROUP BY level")
def entries_by_level(spark, sf_dir):
    return maintain.by_level(entries(spark, sf_dir))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS key, '- **' || p_name || '** — Ann Lee et al., ' || p_brand || CASE WHEN p_size % 4 > 0 THEN ', ' || (1990 + p_size) ELSE '' END || CASE p_size % 3 WHEN 0 THEN ' <https://example.org/' || p_partkey || '>' WHEN 1 THEN ' <https://doi.org/10.1/' || p_partkey || '>' ELSE '' END AS text FROM part"""
)
def cite_markdown(spark, sf_dir):
    """Parts as Markdown citations."""
    k, size, none = _text("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "part").select(
        k.alias("key"), F.col("p_name").alias("title"), F.lit("book").alias("type"), F.array(F.lit("Ann Lee"), F.lit("Bo Li")).alias("authors"), F.when(size % 4 > 0, 1990 + size).alias("year"), F.col("p_brand").alias("venue"), F.when(size % 3 != 2, F.concat(F.lit("10.1/"), k)).alias("doi"), none.alias("arxiv_id"),
        F.when(size % 3 == 0, F.concat(F.lit("https://example.org/"), k)).otherwise("").alias("url"), none.alias("bibtex"), none.alias("level"), none.alias("status"), F.array().cast("array<string>").alias("tags"), size.alias("citation_count"),
    )
    return export.cited(rows, "markdown")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS key, array_to_string(list_filter(['[' || p_partkey || '] ' || p_name, 'Ann Lee, ' || p_brand || ', 2001', CASE WHEN p_size % 2 = 0 THEN 'level: A' END, 'tags: x, ' || lower(p_type), CASE WHEN p_size % 3 > 0 THEN 'summary: about ' || p_name END,
array_to_string(list_transform(range(1, 1 + least(6, p_size % 9)), lambda i: '- S' || i || ': part ' || i), chr(10)), '* found', CASE WHEN p_size % 5 = 0 THEN 'notes: mine' END, CASE WHEN p_size % 4 = 0 THEN 'code: https://zenodo.org/r, printed in the paper' END], lambda x: x <> ''), chr(10)) AS card FROM part"""
)
def entry_cards(spark, sf_dir):
    """What a judge reads of each part as an entry; six sections at most."""
    k, size, none = _text("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    section = lambda i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("name"), F.concat(F.lit("part  "), i.cast("string")).alias("summary"))
    sections = F.slice(F.transform(F.sequence(F.lit(1), F.lit(9)), section), F.lit(1), size % 9)
    rows = _t(spark, sf_dir, "part").select(
        k.alias("key"), F.col("p_name").alias("title"), F.array(F.lit("Ann Lee")).alias("authors"), F.lit(2001).alias("year"), F.col("p_brand").alias("venue"), none.alias("arxiv_id"), F.when(size % 2 == 0, "A").alias("level"), F.array(F.lit("x"), F.lower("p_type")).alias("tags"), F.lit("").alias("one_liner"),
        F.when(size % 3 > 0, F.concat(F.lit("about\n"), F.col("p_name"))).alias("abstract"), sections.alias("sections"), F.array(F.lit("found")).alias("key_findings"), F.when(size % 5 == 0, "mine").otherwise("").alias("notes"), F.when(size % 4 == 0, "https://zenodo.org/r").alias("code_url"), F.lit("paper").alias("code_source"),
    )
    return export.card(rows)


# -- citations and pools -------------------------------------------------------------------------------------

_BLAMED = "SELECT l_orderkey AS node, CAST(l_linenumber * 10000000 + l_partkey AS BIGINT) AS ord, coalesce(CASE WHEN l_suppkey % 7 > 0 THEN l_discount END, 0.5) AS confidence, l_partkey AS who FROM lineitem"


@query(
    f"""WITH a AS ({_BLAMED}), b AS (SELECT *, row_number() OVER (PARTITION BY node, who ORDER BY confidence DESC, ord) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, ord) AS place FROM b WHERE n = 1)
SELECT node, ord, CAST(place AS INTEGER) AS place FROM c WHERE place <= 3"""
)
def next_references(spark, sf_dir):
    """The three references that each order's reading blames most, each work once."""
    c, none = F.col, F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("node"), (c("l_linenumber") * 10000000 + c("l_partkey")).alias("ord"), F.when(c("l_suppkey") % 7 > 0, c("l_discount")).alias("confidence"), F.concat(F.lit("Work "), c("l_partkey").cast("string")).alias("title"),
        F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("10.1/"), c("l_partkey").cast("string"))).otherwise("").alias("doi"), none.alias("arxiv_id"),
    )
    return citations.next_references(rows).select("node", "ord", "place")


@query(
    """SELECT node, ord, is_origin FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY is_origin DESC, coalesce(y, 9999), ord) AS n FROM (SELECT l_orderkey AS node, CAST(l_linenumber * 10000000 + l_partkey AS BIGINT) AS ord, l_quantity > 45 AS is_origin,
CASE WHEN l_suppkey % 5 > 0 THEN year(l_shipdate) END AS y FROM lineitem WHERE l_returnflag <> 'R' AND l_tax > 0.02)) WHERE n = 1"""
)
def best_next(spark, sf_dir):
    """Of the readable works that state a claim the origin, else the oldest."""
    c = F.col
    rows = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("node"), (c("l_linenumber") * 10000000 + c("l_partkey")).alias("ord"), (c("l_quantity") > 45).alias("is_origin"), (c("l_returnflag") != "R").alias("readable"), (c("l_tax") > 0.02).alias("states_claim"), F.when(c("l_suppkey") % 5 > 0, F.year("l_shipdate")).otherwise(0).alias("year"))
    return citations.best_next(rows).select("node", "ord", "is_origin")


@query(
    """SELECT l_orderkey AS start, string_agg('P' || l_suppkey || CASE WHEN l_partkey % 2 = 0 THEN ' et al.' ELSE '' END || ' (' || CASE WHEN l_partkey % 3 = 0 THEN 'n.d.' ELSE CAST(year(l_shipdate) AS VARCHAR) END || ')', ' -> ' ORDER BY l_linenumber * 10000000 + l_partkey, l_suppkey, l_shipdate) AS chain
FROM lineitem GROUP BY l_orderkey"""
)
def chain_labels(spark, sf_dir):
    """Each order's line items as a walk of labels."""
    c = F.col
    first = F.concat(F.lit("Ann P"), c("l_suppkey").cast("string"))
    label = citations.hop_label(F.when(c("l_partkey") % 2 == 0, F.array(first, F.lit("Bo Li"))).otherwise(F.array(first)), F.when(c("l_partkey") % 3 != 0, F.year("l_shipdate")))
    hop = F.struct((c("l_linenumber") * 10000000 + c("l_partkey")).alias("n"), "l_suppkey", "l_shipdate")
    return citations.chain_text(_t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("start"), hop.alias("hop"), label.alias("label")))


@query(
    """WITH r AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS cocitations FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2)
SELECT 'worknumber' || l_partkey AS cited, cocitations, 'Work number ' || l_partkey AS title FROM r"""
)
def mined_references(spark, sf_dir):
    """Works that several orders cite and the library lacks."""
    c, none = F.col, F.lit(None).cast("string")
    l = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    ref = F.struct(F.concat(F.lit("Work number "), c("l_partkey").cast("string")).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), none.alias("doi"), none.alias("arxiv_id"))
    citing = l.groupBy("l_orderkey").agg(F.collect_list(ref).alias("references")).select(F.concat(F.lit("o"), _text("l_orderkey")).alias("key"), F.concat(F.lit("Order "), _text("l_orderkey")).alias("title"), "references")
    held = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), _text("p_partkey")).alias("key"), F.concat(F.lit("WORK Number "), _text("p_partkey")).alias("title"), F.array().cast(citing.schema["references"].dataType).alias("references"))
    return citations.mine_references(citing.unionByName(held).withColumns({"doi": none, "arxiv_id": none})).select("cited", "cocitations", "title")


@query("SELECT count(*) AS total, count(*) FILTER (p_size % 4 = 0) AS from_references, count(*) FILTER (p_size % 4 = 1) AS from_search, count(*) FILTER (p_size % 4 = 2) AS from_scouts, count(*) FILTER (p_size % 4 = 3) AS from_both, count(*) FILTER (p_size % 3 = 0) AS without_citations FROM part")
def pool_report(spark, sf_dir):
    """How a pool came about."""
    source = F.get(F.array(*[F.lit(x) for x in ("references", "search", "scout", "both")]), F.col("p_size") % 4)
    return actions.pool_report(_t(spark, sf_dir, "part").select(source.alias("source"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("citation_count")))


@query("SELECT doc_id AS dedup_key, CASE WHEN max(quality) IS NOT NULL THEN CAST(least(1.0, greatest(0.0, max(1.5 * quality - 0.2))) AS DOUBLE) END AS relevance FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def judged_relevance(spark, sf_dir):
    """A judge's scores between 0 and 1; works that it passes over have none."""
    pool = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("dedup_key"))
    return ranking.with_relevance(pool, _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("dedup_key"), (1.5 * F.col("quality") - 0.2).alias("score")))


@query(
    """WITH c AS (SELECT p_partkey AS arrival, '10.1/' || (p_partkey // 2) AS ident, CASE WHEN p_size % 3 > 0 THEN p_size END AS cites, CASE WHEN p_size % 4 > 0 THEN 'V' END AS venue FROM part),
n AS (SELECT *, cites IS NULL OR venue IS NULL AS pending, row_number() OVER (PARTITION BY ident, cites IS NULL OR venue IS NULL ORDER BY arrival) AS n FROM c)
SELECT arrival, CAST(coalesce(cites, CASE WHEN pending AND n = 1 THEN 7 END) AS BIGINT) AS citation_count, coalesce(venue, CASE WHEN pending AND n = 1 THEN 'ICML' END) AS venue, CASE WHEN pending AND n = 1 AND (arrival // 2) % 2 = 0 THEN 'a' || (arrival // 2) END AS arxiv_id FROM n"""
)
def enriched_pool(spark, sf_dir):
    """Candidates filled from records; the first candidate of an identifier only, and no identity from a title match."""
    k, size, half, none = F.col("p_partkey"), F.col("p_size"), F.expr("p_partkey div 2"), F.lit(None).cast("string")
    p = _t(spark, sf_dir, "part")
    ident = F.concat(F.lit("10.1/"), half.cast("string"))
    pool = p.select(k.alias("arrival"), ident.alias("doi"), none.alias("arxiv_id"), F.when(size % 3 > 0, size).cast("bigint").alias("citation_count"), F.when(size % 4 > 0, "V").alias("venue"), F.lit(None).cast("int").alias("year"))
    found = p.select(ident.alias("work"), F.lit(7).cast("bigint").alias("citation_count"), F.lit("ICML").alias("venue"), F.lit(1999).alias("year"), none.alias("doi"), F.concat(F.lit("a"), half.cast("string")).alias("arxiv_id"), (half % 2 == 1).alias("title_matched")).distinct()
    return ranking.enriched(pool, found).select("arrival", "citation_count", "venue", "arxiv_id")


@query("SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY event_type")
def model_usage(spark, sf_dir):
    """Calls and cost of each model from a log."""
    return providers.usage(_t(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("cost"))).withColumn("cost", F.round("cost", 4))


@query(
    """SELECT p_partkey, v IN ('Elsevier BV', 'Springer') AS publisher, v IN ('bioRxiv', 'arXiv preprint arXiv:1') AS preprint_host, v = 'ICML Workshops' AS workshop, v IN ('Elsevier BV', 'Springer', 'bioRxiv', 'arXiv preprint arXiv:1', 'n/a') AS placeholder
FROM (SELECT p_partkey, ['bioRxiv', 'Elsevier BV', 'ICML', 'n/a', 'arXiv preprint arXiv:1', 'Springer', 'ICML Workshops', p_brand][1 + p_size % 8] AS v FROM part)"""
)
def venue_kinds(spark, sf_dir):
    """Venue strings that name publishers, preprint servers, workshops or nothing."""
    v = F.get(F.array(*[F.lit(x) for x in ("bioRxiv", "Elsevier BV", "ICML", "n/a", "arXiv preprint arXiv:1", "Springer", "ICML Workshops")], F.col("p_brand")), F.col("p_size") % 8)
    return _t(spark, sf_dir, "part").select("p_partkey", venues.is_publisher(v).alias("publisher"), venues.is_preprint_host(v).alias("preprint_host"), venues.is_workshop(v).alias("workshop"), venues.is_placeholder(v).alias("placeholder"))
