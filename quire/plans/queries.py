"""The registered queries of the bibliographic operators over the driver's tables, each beside the SQL of its result.

How the tables stand in for a library is in ``plans/tables.py``. Every query reads its whole tables; limits are features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import documents as texts
from quire.functions import identifiers, titles, venues
from quire.operators import citations, export, identity, maintain, quality, ranking
from quire.operators import search as searching
from quire.plans import client_queries, entry_queries, index_queries, report_queries, state_queries, time_queries  # noqa: F401  they register their queries
from quire.plans.tables import ENTRIES, ORACLES, QUERIES, entries, query  # noqa: F401
from quire.plans.tables import table as _t

AS_OF = 2002
WORD_FORMS = ("things", "theres", "ered", "Où")
BM25_TERMS = ["eran", "thing", "tionly", "erthe"]


def _bm25_sql(fields: str, weighted: str) -> str:
    terms = ", ".join(f"'{t}'" for t in BM25_TERMS)
    return f"""
WITH f AS ({fields}),
l AS (SELECT doc_id, sum(len(t)) AS n FROM f GROUP BY doc_id),
w AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
p AS (SELECT doc_id, term, sum(w) AS f FROM (SELECT doc_id, w, unnest(t) AS term FROM f) WHERE term IN ({terms}) GROUP BY doc_id, term),
d AS (SELECT term, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, w GROUP BY term, docs)
SELECT doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
FROM p JOIN d USING (term) JOIN l USING (doc_id), w GROUP BY doc_id ORDER BY score, doc_id LIMIT 50
"""


def _bm25(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    hits = searching.Index.build(rows, weights, key="doc_id").scores(BM25_TERMS)
    return hits.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(50)


@query(_bm25_sql("SELECT doc_id, 1.0::DOUBLE AS w, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents", "1"))
def bm25_search(spark, sf_dir):
    """The best 50 documents for four terms."""
    return _bm25(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"text": 1.0})


@query(
    _bm25_sql(
        "SELECT doc_id, 8.0::DOUBLE AS w, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+') AS t FROM documents UNION ALL SELECT doc_id, 2.0, regexp_extract_all(lower(substr(text, length(split_part(text, chr(10), 1)) + 2)), '[a-z0-9]+') FROM documents",
        "",
    )
)
def bm25_fielded(spark, sf_dir):
    """The same with a title (the first line) that counts four times as much as the rest."""
    title = F.substring_index("text", "\n", 1)
    rows = _t(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("body"))
    return _bm25(rows, {"title": 8.0, "body": 2.0})


@query()
def search_word_forms(spark, sf_dir):
    """All documents that hold a form of one of four words, without regard to accents; SQL has no stemmer."""
    index = searching.Index.build(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"text": 1.0}, key="doc_id", fold=True, stem=True)
    words = spark.range(1).select(searching.tokens(F.lit(" ".join(WORD_FORMS)), fold=True, stem=True)).first()[0]
    return index.scores(words).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    """WITH c AS (SELECT p_partkey, CAST(160 + (p_partkey * 37) % 50000 AS INTEGER) AS n FROM part)
SELECT p_partkey, 'a' || chr(n) || 'b' || chr(n + 7) || CASE p_partkey % 4 WHEN 0 THEN '—' WHEN 1 THEN '’' WHEN 2 THEN 'é' ELSE '&unknown;' END || ' & ' || chr(128512) AS text FROM c"""
)
def html_references(spark, sf_dir):
    """Numbered, hexadecimal and named character references of a whole table's rows, decoded."""
    n = 160 + (F.col("p_partkey") * 37) % 50000
    kind = F.get(F.array(*[F.lit(x) for x in ("&mdash;", "&rsquo;", "&eacute;", "&unknown;")]), (F.col("p_partkey") % 4).cast("int"))
    raw = F.concat(F.lit("a&#"), n.cast("string"), F.lit(";b&#x"), F.hex(n + 7), F.lit(";"), kind, F.lit(" &amp; &#x1F600;"))
    return _t(spark, sf_dir, "part").select("p_partkey", venues.unescaped(raw).alias("text"))


@query(
    f"""SELECT item_id, array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: '"' || x || '"'), ' OR ') AS match
FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_+#.-]*'), lambda x: length(x) > 1 AND lower(x) NOT IN ({", ".join(f"'{w}'" for w in sorted(searching.STOPWORDS))})) AS w FROM benchmark)"""
)
def fts_query_rewrite(spark, sf_dir):
    """Benchmark texts as full-text expressions."""
    return _t(spark, sf_dir, "benchmark").select("item_id", searching.match_column(F.col("text")).alias("match"))


@query(f"SELECT key, CAST(lrank * 1000 - coalesce(year, 0) AS DOUBLE) AS score FROM ({ENTRIES}) ORDER BY score, key LIMIT 200")
def listing_blank_query(spark, sf_dir):
    """What a search without words lists."""
    return searching.search(entries(spark, sf_dir), "", limit=200).select("key", "score")


@query(f"SELECT key, level, year, status FROM ({ENTRIES}) WHERE lrank <= 2 AND year BETWEEN 1996 AND 1999 AND list_contains(tags, 'high') AND status = 'verified'")
def filter_level_year_tag(spark, sf_dir):
    """Structured filters; a missing year is out."""
    return searching.matching(entries(spark, sf_dir), level="B", tag="HIGH", year_from=1996, year_to=1999, status="verified").select("key", "level", "year", "status")


@query(f"SELECT key, level, citation_count FROM ({ENTRIES}) WHERE status <> 'verified' AND lrank <= 1 ORDER BY lrank, citation_count DESC, key LIMIT 100")
def read_backlog(spark, sf_dir):
    """Entries still to read, best levels and most cited first."""
    return searching.backlog(entries(spark, sf_dir), level="A", limit=100).select("key", "level", "citation_count")


@query(f"SELECT key, year FROM ({ENTRIES}) ORDER BY coalesce(year, 0) DESC, key LIMIT 200")
def listed_by_year(spark, sf_dir):
    """A listing by year."""
    return searching.listed(entries(spark, sf_dir), sort="year").select("key", "year")


@query(f"SELECT key, year FROM ({ENTRIES}) WHERE year IS NULL OR year BETWEEN 1997 AND 1998")
def plan_window(spark, sf_dir):
    """A search plan's window; a missing year is in."""
    return entries(spark, sf_dir).where(ranking.within_window(F.col("year"), 1997, 1998)).select("key", "year")


@query(
    f"""WITH e AS ({ENTRIES}) SELECT 'all' AS facet, NULL AS value, count(*) AS n FROM e UNION ALL SELECT 'level', level, count(*) FROM e GROUP BY level
UNION ALL SELECT 'status', status, count(*) FROM e GROUP BY status UNION ALL SELECT 'type', type, count(*) FROM e GROUP BY type"""
)
def library_stats(spark, sf_dir):
    """Counts by level, status and type in one pass."""
    return maintain.statistics(entries(spark, sf_dir))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def top_tags(spark, sf_dir):
    """The most frequent tags."""
    return maintain.top_tags(_t(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags")))


def _links(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


@query("SELECT l_partkey AS cited, count(DISTINCT l_orderkey) AS cocitations FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2")
def cocitation_mining(spark, sf_dir):
    """Distinct citing orders of each part."""
    return citations.cocited(_links(spark, sf_dir))


@query("SELECT l_partkey AS cited, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_partkey HAVING count(*) >= 2 ORDER BY n DESC, cited LIMIT 100")
def expand_references(spark, sf_dir):
    """References counted with repeats, those in the library left out."""
    known = _t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("cited"))
    return citations.expansion(_links(spark, sf_dir), 100, known=known)


@query(
    """WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n
FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def cocitation_pairs(spark, sf_dir):
    """Parts that at least two orders cite together."""
    return citations.cocitation_pairs(_links(spark, sf_dir))


@query("SELECT p_partkey, substr(lower(regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9]+', '', 'g')), 1, 12) AS slug FROM part")
def slug_title(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", identifiers.slug(F.concat_ws(" ", "p_name", "p_brand"), 12).alias("slug"))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS folded FROM documents")
def fold_text(spark, sf_dir):
    """A digest of each text as containment sees it."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(identifiers.folded(F.col("text")).cast("binary")).alias("folded"))


@query(
    r"""SELECT p_partkey, '10.' || (1000 + p_partkey) || '/' || replace(lower(p_brand), '#', '.') || '.' || p_size AS doi,
lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 5, '0') AS arxiv_id FROM part"""
)
def doi_arxiv_extract(spark, sf_dir):
    """Identifiers found in prose and URLs."""
    doi = F.concat(F.lit("see https://doi.org/10."), (1000 + F.col("p_partkey")).cast("string"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit(".")), F.lit("."), F.col("p_size").cast("string"), F.lit(")."))
    arxiv = F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 5, "0"), F.lit("v2"))
    return _t(spark, sf_dir, "part").select("p_partkey", identifiers.normal_doi(doi).alias("doi"), identifiers.normal_arxiv(arxiv).alias("arxiv_id"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://github.com/acme/r' || s_suppkey WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'https://zenodo.org/record' END AS code_url FROM supplier")
def code_urls(spark, sf_dir):
    """Repository links: cleaned, and refused where only an owner is named."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("(http://www.GitHub.com/acme/r"), k.cast("string"), F.lit("/#readme)."))).when(k % 3 == 1, F.lit("github.com/acme")).otherwise(F.lit("zenodo.org/record."))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", identifiers.normal_code_url(raw).alias("code_url"))


@query(
    """WITH t AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS w FROM part)
SELECT a.id, round(CASE WHEN len(list_intersect(a.w, b.w)) > 0 THEN 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) ELSE 0.0 END, 6) AS similarity
FROM t a JOIN t b ON b.id = a.id + 1"""
)
def title_similarity(spark, sf_dir):
    """Token F1 of neighbouring part names."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("title").alias("other"))
    return p.join(q, "id").select("id", F.round(titles.token_f1(titles.title_tokens(F.col("title")), titles.title_tokens(F.col("other"))), 6).alias("similarity"))


@query(
    """WITH q AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS w, lower(regexp_replace(p_name || ' ' || p_type, '[^a-zA-Z0-9]+', '', 'g')) AS s FROM part WHERE p_partkey % 50 = 0),
c AS (SELECT p_partkey AS cand, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS w, lower(regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9]+', '', 'g')) AS s, p_size FROM part),
m AS (SELECT id, cand, p_size, CASE WHEN q.s = c.s THEN 1.0 ELSE 2.0 * len(list_intersect(q.w, c.w)) / (len(q.w) + len(c.w)) END AS f FROM q, c)
SELECT id, cand, round(f, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f DESC, p_size DESC, cand) AS n FROM m WHERE f >= 0.5) WHERE n = 1"""
)
def title_f1_match(spark, sf_dir):
    """The best matching part for every fiftieth title, ties by citations."""
    p = _t(spark, sf_dir, "part")
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    c = p.select(F.col("p_partkey").alias("cand"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_size").alias("citation_count"))
    return identity.best_title_matches(q, c, threshold=0.5).withColumn("similarity", F.round("similarity", 6))


# The text folded as ``identifiers.ascii_fold`` does it.
_SLUG = f"substr(lower(regexp_replace(regexp_replace(translate(text, '{identifiers._FROM}', '{identifiers._TO}'), '\\p{{M}}+', '', 'g'), '[^a-zA-Z0-9]+', '', 'g')), 1, 200)"


@query(
    f"""WITH i AS (SELECT doc_id, 'doi' AS kind, CASE WHEN doc_id % 2 = 0 THEN '10.5555/' || md5(text) END AS value FROM documents
UNION ALL SELECT doc_id, 'arxiv', CASE WHEN doc_id % 3 = 0 THEN 'doc/' || md5(right(text, 200)) END FROM documents
UNION ALL SELECT doc_id, 'title', {_SLUG} FROM documents)
SELECT id, min(first) AS key FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY kind, value) AS first FROM i WHERE value <> '') GROUP BY id"""
)
def find_duplicate(spark, sf_dir):
    """For each document of any language the first one with its DOI, arXiv id or title slug.

    The texts hold no identifiers: a digest of the text stands for the DOI, one of its end for the arXiv id.
    """
    c = F.col
    d = _t(spark, sf_dir, "documents").select(
        c("doc_id").alias("key"), F.when(c("doc_id") % 2 == 0, F.concat(F.lit("10.5555/"), F.upper(F.md5(c("text").cast("binary"))))).alias("doi"),
        F.when(c("doc_id") % 3 == 0, F.concat(F.lit("doc/"), F.md5(F.right("text", F.lit(200)).cast("binary")))).alias("arxiv_id"), c("text").alias("title"),
    )
    return identity.find_duplicates(d.withColumnRenamed("key", "id"), d)


@query(
    """WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '') || 'k' AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)
SELECT id, base || CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE CAST(n - 25 AS VARCHAR) END AS key FROM n"""
)
def unique_key(spark, sf_dir):
    """A free key for every part."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.lit("k")).alias("base"))
    return identity.unique_keys(p, p.select(F.lit("unrelated").alias("key")).limit(1)).select("id", "key")


@query("SELECT c_custkey, substr(lower(regexp_replace(split_part(c_name, '#', 2), '[^a-zA-Z0-9]+', '', 'g')), 1, 20) || '1999' || lower(c_mktsegment) AS key FROM customer")
def citation_key(spark, sf_dir):
    """Surname, year and the first title word that means something."""
    author = F.array(F.concat(F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)), F.lit(", C.")))
    return _t(spark, sf_dir, "customer").select("c_custkey", identifiers.citation_key(author, F.lit(1999), F.concat(F.lit("On the "), F.col("c_mktsegment"), F.lit(" of things"))).alias("key"))


def _cites(spark, sf_dir):
    """Parts as works: citations are line items, the year is that of the first shipment, the venue is in the brand."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("citation_count"), F.min(F.year("l_shipdate")).alias("year"))
    p = _t(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"))
    venue = F.when(F.col("p_size") % 5 == 0, "NeurIPS 2001").when(F.col("p_size") % 5 == 1, "Journal of AISTATS").when(F.col("p_size") % 5 == 2, "NeurIPS Workshops").when(F.col("p_size") % 5 == 3, "Elsevier BV").otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") % 7 == 0, "preprint").otherwise("conference paper")
    return p.select("p_partkey", (F.col("citation_count") * (1 + F.col("p_size"))).alias("citation_count"), "year", venue.alias("venue"), kind.alias("type"))


CITES = """
SELECT p_partkey, n.c * (1 + p_size) AS citation_count, n.year, CASE p_size % 5 WHEN 0 THEN 'NeurIPS 2001' WHEN 1 THEN 'Journal of AISTATS' WHEN 2 THEN 'NeurIPS Workshops' WHEN 3 THEN 'Elsevier BV' ELSE p_brand END AS venue,
  CASE WHEN p_size % 7 = 0 THEN 'preprint' ELSE 'conference paper' END AS type, CASE p_size % 5 WHEN 0 THEN 'A*' WHEN 1 THEN 'A' END AS vlevel, p_size
FROM part JOIN (SELECT l_partkey, count(*) AS c, CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY l_partkey) n ON p_partkey = l_partkey
"""


@query(f"SELECT p_partkey, round(citation_count / greatest({AS_OF} - year, 1), 6) AS velocity FROM ({CITES})")
def citation_velocity(spark, sf_dir):
    return _cites(spark, sf_dir).select("p_partkey", F.round(quality.citations_per_year(F.col("citation_count"), F.col("year"), AS_OF), 6).alias("velocity"))


ASSESSED = f"""
SELECT p_partkey, type, CASE
  WHEN vlevel IS NOT NULL AND NOT soft AND vlevel = 'A' AND v >= 100 THEN 'A*' WHEN vlevel IS NOT NULL AND NOT soft THEN vlevel
  WHEN age >= 1 AND v >= 100 THEN CASE WHEN soft AND v < 200 THEN 'A' ELSE 'A*' END WHEN age >= 1 AND v >= 25 THEN 'A' WHEN age >= 1 AND v >= 5 THEN 'B'
  WHEN age > 2 THEN 'C' ELSE 'unranked' END AS level,
  CASE WHEN vlevel IS NOT NULL AND NOT soft THEN false WHEN age >= 1 AND v >= 5 THEN false WHEN age > 2 THEN vlevel IS NULL ELSE true END AS judge
FROM (SELECT *, type = 'preprint' OR p_size % 5 = 2 AS soft, citation_count / greatest({AS_OF} - year, 1) AS v, {AS_OF} - year AS age FROM ({CITES}))
"""


@query(f"SELECT p_partkey, level, judge AS needs_judgement FROM ({ASSESSED})")
def assess_level(spark, sf_dir):
    """The level ladder: venue, velocity, ceilings, age."""
    rows = venues.venue_levels(_cites(spark, sf_dir))
    c = F.col
    return rows.select("p_partkey", F.inline(F.array(quality.assessed(c("venue"), c("type"), c("year"), c("citation_count"), AS_OF, c("venue_level"))))).select("p_partkey", "level", "needs_judgement")


@query(f"SELECT p_partkey, judge OR level IN ('A*', 'A') AS ok FROM ({ASSESSED})")
def quality_bar(spark, sf_dir):
    """Which works a library with minimum A admits."""
    rows, c = venues.venue_levels(_cites(spark, sf_dir)), F.col
    rows = rows.withColumn("v", quality.assessed(c("venue"), c("type"), c("year"), c("citation_count"), AS_OF, c("venue_level")))
    return rows.select("p_partkey", quality.passes_bar(c("v"), c("type"), "A")["ok"].alias("ok"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ICML' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'KDD' END AS name, CASE p_size % 4 WHEN 0 THEN 'A*' WHEN 3 THEN 'A*' END AS level,
CASE p_size % 4 WHEN 0 THEN 'Proc. ICML & friends' WHEN 1 THEN 'Springer' WHEN 3 THEN 'ACM SIGKDD' END AS clean FROM part"""
)
def venue_level(spark, sf_dir):
    """Venue cleaning and the ordered table of ranked venues."""
    raw = F.get(F.array(F.lit("<i>Proc. ICML</i> &amp;amp; friends."), F.lit("Springer,"), F.lit(" N/A "), F.lit("ACM  SIGKDD;")), (F.col("p_size") % 4).cast("int"))
    hit = venues.venue_level(raw)
    return _t(spark, sf_dir, "part").select("p_partkey", hit["name"].alias("name"), hit["level"].alias("level"), venues.clean_venue(raw).alias("clean"))


@query(
    f"""WITH c AS (SELECT p_partkey, citation_count / greatest({AS_OF} - year, 1) AS v, year, CASE p_size % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.55 WHEN 3 THEN 0.3 WHEN 4 THEN 0.4 END AS pts, p_size % 5 AS coc, 1 + p_size % 3 AS ang, q.quality FROM ({CITES}) c LEFT JOIN labels q ON q.doc_id = p_partkey),
s AS (SELECT *, least(1.0, log10(1 + greatest(v, 0.0)) / log10(101.0)) AS vel, 0.6 * least(1.0, coc / 3.0) + 0.4 * least(1.0, greatest(0, ang - 1) / 2.0) AS loc FROM c),
w AS (SELECT *, CASE WHEN year >= {AS_OF} - 2 THEN pts ELSE coalesce(0.6 * vel + 0.4 * pts, vel, pts) END AS world FROM s),
i AS (SELECT *, least(1.0, 0.7 * coalesce(world, 0.35) + 0.3 * loc) AS imp FROM w)
SELECT p_partkey, round(imp, 6) AS importance, round(0.65 * coalesce(CAST(quality AS DOUBLE), 0.5) + 0.35 * imp, 6) AS rank FROM i"""
)
def candidate_rank(spark, sf_dir):
    """World and local scores, importance and rank; labels stand in for a judge's relevance."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = _cites(spark, sf_dir).join(p, "p_partkey").join(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("p_partkey"), F.col("quality").cast("double").alias("relevance")), "p_partkey", "left")
    level = F.get(F.array(*[F.lit(x) for x in ("A*", "A", "B", "C", "unranked")], F.lit(None).cast("string")), (F.col("p_size") % 6).cast("int"))
    velocity = ranking.velocity_score(quality.citations_per_year(F.col("citation_count"), F.col("year"), AS_OF))
    world = ranking.world_score(velocity, ranking.venue_score(level), F.col("year"), AS_OF)
    value = ranking.importance(world, ranking.local_score(F.col("p_size") % 5, 1 + F.col("p_size") % 3))
    return rows.select("p_partkey", F.round(value, 6).alias("importance"), F.round(ranking.rank_score(F.col("relevance"), value), 6).alias("rank"))


@query(
    """WITH c AS (SELECT p_partkey, p_size % 4 AS coc, 1 + p_size % 2 AS ang, p_size % 4 > 0 OR p_size % 2 > 0 AS strong, p_size AS year FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY strong ORDER BY ang + coc DESC, year DESC, p_partkey) AS n, count(*) FILTER (strong) OVER () AS s, count(*) FILTER (NOT strong) OVER () AS w FROM c),
t AS (SELECT *, least(w, 15) AS res FROM r)
SELECT p_partkey FROM t WHERE CASE WHEN strong THEN n <= 50 - res ELSE n <= greatest(res, 50 - s) END"""
)
def trim_pool_quota(spark, sf_dir):
    """A pool of 50 with room for uncorroborated work."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("coc"), (1 + F.col("p_size") % 2).alias("ang"), F.col("p_size").alias("year"))
    order = [*ranking.triage(F.col("ang"), F.col("coc"), F.col("year")), F.col("p_partkey")]
    return ranking.trimmed(rows, 50, strong=ranking.corroborated(F.col("coc"), F.col("ang")), order=order).select("p_partkey")


@query(
    """WITH l AS (SELECT 'a' AS source, p_name AS who, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part UNION ALL SELECT 'b', p_name, row_number() OVER (ORDER BY p_size, p_partkey) FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY place, source) AS n FROM l)
SELECT who, source, row_number() OVER (ORDER BY place, source) AS position FROM f WHERE n = 1"""
)
def facet_interleave(spark, sf_dir):
    """Two ranked lists dealt in turn, each name once."""
    p = _t(spark, sf_dir, "part")
    a = p.select(F.lit("a").alias("source"), F.col("p_name").alias("who"), (-F.col("p_retailprice")).alias("x"), "p_partkey")
    b = p.select(F.lit("b").alias("source"), F.col("p_name").alias("who"), F.col("p_size").cast("double").alias("x"), "p_partkey")
    return ranking.interleaved(a.unionByName(b).withColumn("place", F.struct("x", "p_partkey"))).select("who", "source", "position")


@query(
    """WITH c AS (SELECT p_partkey AS arrival, p_name AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS year, p_partkey % 4 AS coc, CASE WHEN p_partkey % 2 = 0 THEN 'search' ELSE 'scout' END AS source FROM part)
SELECT substr(replace(title, ' ', ''), 1, 120) AS dedup_key, min(arrival) AS arrival, arg_min(year, arrival) FILTER (year IS NOT NULL) AS year, max(coc) AS cocitations, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source
FROM c GROUP BY 1"""
)
def pool_merge(spark, sf_dir):
    """Candidates of several sources merged by identity."""
    null = F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("arrival"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("year"), null.alias("doi"), null.alias("arxiv_id"), (F.col("p_partkey") % 4).alias("cocitations"),
        F.when(F.col("p_partkey") % 2 == 0, "search").otherwise("scout").alias("source"), F.array("p_type").alias("angles"),
    )
    return ranking.absorbed(rows).select("dedup_key", "arrival", "year", "cocitations", "source")


_ELEMENTS = "script|style|nav|header|footer|noscript|svg|form"


def _html_sql() -> str:
    t = "html"
    for e in _ELEMENTS.split("|"):
        t = f"regexp_replace({t}, '<{e}\\b.*?</{e}>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<!--.*?-->', ' ', 'gs')"
    t = f"regexp_replace({t}, '</(p|div|section|h[1-6]|li|tr|br|title)\\s*>', chr(10), 'gi')"
    t = f"regexp_replace(regexp_replace({t}, '<br\\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t\u00a0]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, trim(array_to_string(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10)) AS text FROM pages"


@query(_html_sql())
def html_to_text(spark, sf_dir):
    """Markup to text by rules, as the library's reader does it."""
    return _t(spark, sf_dir, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("text"))


@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k,
  t <> '' AND length(t) <= 120 AND regexp_matches(t, '[A-Za-z]{3}') AND len(regexp_split_to_array(t, '\s+')) <= 14 AS ok FROM s),
r AS (SELECT doc_id, coalesce(sum(length(t)) FILTER (ok AND n >= 4 AND k > 1), 0) AS gone FROM c GROUP BY doc_id)
SELECT c.doc_id, md5(CASE WHEN r.gone > 0.25 * length(any_value(d.text)) THEN any_value(d.text) ELSE string_agg(line, chr(10) ORDER BY i) FILTER (NOT (ok AND n >= 4 AND k > 1)) END) AS digest
FROM c JOIN r USING (doc_id) JOIN documents d USING (doc_id) GROUP BY c.doc_id, r.gone"""
)
def boilerplate_dedupe(spark, sf_dir):
    """Running lines kept once; a digest of each text."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(texts.without_running_lines(F.col("text")).cast("binary")).alias("digest"))


@query(
    """SELECT doc_id, length(text) > 1000 AS truncated, CASE WHEN length(text) > 1000 THEN substr(text, 1, 700) || chr(10) || chr(10) || '[... middle of document omitted to fit context ...]' || chr(10) || chr(10) || right(text, 300) ELSE text END AS text FROM documents"""
)
def truncate_head_tail(spark, sf_dir):
    """Texts fitted to 1000 characters."""
    return texts.for_prompt(_t(spark, sf_dir, "documents").select("doc_id", "text"), 1000).select("doc_id", "truncated", "text")


@query("SELECT doc_id, length(text) >= 4000 OR length(text) >= least(4000, greatest(600, 250 * (doc_id % 9))) AND doc_id % 9 > 0 AS usable FROM documents")
def usable_text(spark, sf_dir):
    """Which texts are long enough for their pages."""
    return _t(spark, sf_dir, "documents").select("doc_id", texts.usable(F.col("text"), F.col("doc_id") % 9).alias("usable"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 400 AS total, p_size % 13 AS b FROM part),
f AS (SELECT *, least(greatest(1, b // 3), b) AS front FROM p), g AS (SELECT *, CASE WHEN b - front >= 1 THEN greatest(1, b // 4) ELSE 0 END AS back FROM f), h AS (SELECT *, greatest(0, b - front - back) AS mid FROM g)
SELECT p_partkey, array_to_string(CASE WHEN b <= 0 OR total <= b THEN range(0, total) ELSE list_sort(list_distinct(range(0, front) || list_transform(range(0, mid), lambda i: CAST(floor(front + i * ((total - back - front) / greatest(mid, 1))) AS BIGINT)) || range(total - back, total)))[1:b] END, ',') AS pages FROM h"""
)
def page_selection(spark, sf_dir):
    """The pages to read of long documents."""
    pages = texts.chosen_pages(F.col("p_partkey") % 400, F.col("p_size") % 13)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query(r"""SELECT doc_id, coalesce(round(len(regexp_extract_all(text, '(?im)\b(?:19|20)\d{2}\b|^\s*\[\d{1,3}\]|^\s*\(\d{1,3}\)|\bet\s+al\b|\barXiv\b|\bdoi\b|\bdoi\.org|https?://|\bpp\.\s*\d|\bvol\.\s*\d|\bIn\s+Proc|\bProceedings\b|\bJournal\b|\bConference\b|\bpreprint\b')) / nullif(length(text), 0) * 1000, 6), 0.0) AS density FROM documents""")
def marker_density(spark, sf_dir):
    """Bibliographic markers in 1000 characters."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(texts.marker_density(F.col("text")), 6).alias("density"))


@query(
    """WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM documents), b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS q FROM benchmark)
SELECT doc_id, item_id FROM d, b WHERE contains(t, q) AND length(q) >= 24"""
)
def evidence_grounding(spark, sf_dir):
    """Quotes found verbatim in texts.

    A text is cut into pieces of twelve folded characters; a quote offers the twelve windows of that size at its start,
    one of which must be a piece of any text that holds it. They are equi-joined, and the whole quote is the test.
    """
    quotes = _t(spark, sf_dir, "benchmark").select("item_id", identifiers.folded(F.col("text")).alias("q")).where("length(q) >= 24")
    heads = quotes.select("item_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(F.col("q"), i, F.lit(12))))).alias("piece"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", identifiers.folded(F.col("text")).alias("t"))
    pieces = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("(.{12})"), F.lit(1)))).alias("piece"))
    side = F.broadcast(heads) if heads.count() <= 1_000_000 else heads
    met = pieces.join(side, "piece").select("doc_id", "item_id").distinct()
    return met.join(docs, "doc_id").join(quotes, "item_id").where(F.contains("t", F.col("q"))).select("doc_id", "item_id")


@query(
    f"""WITH e AS ({ENTRIES}) SELECT key, 'venue' AS field, 'a ' || type || ' with no venue recorded' AS problem FROM e WHERE key % 3 = 0
UNION ALL SELECT key, 'venue', 'venue ''Elsevier BV'' names a publisher, not a venue' FROM e WHERE key % 3 = 1
UNION ALL SELECT key, 'type', 'venue names a workshop but type is ''' || type || '''' FROM e WHERE key % 3 = 2
UNION ALL SELECT key, 'year', 'no year recorded' FROM e WHERE year IS NULL
UNION ALL SELECT key, 'year', 'year ' || year || ' predates the paper''s own arXiv posting (1999)' FROM e WHERE year < 1999
UNION ALL SELECT key, 'citation_count', 'no citations recorded for a paper ' || ({AS_OF} - year) || ' years old' FROM e WHERE citation_count = 0 AND {AS_OF} - year >= 3
UNION ALL SELECT key, 'authors', 'author list collapsed to ''Kim et al.''' FROM e WHERE key % 4 = 0 UNION ALL SELECT key, 'authors', 'no authors recorded' FROM e WHERE key % 4 = 1
UNION ALL SELECT key, 'title', 'title still carries unrendered markup' FROM e WHERE key % 5 = 0"""
)
def metadata_audit(spark, sf_dir):
    """Findings of the audit rules, one row each."""
    k = F.col("key")
    rows = entries(spark, sf_dir).withColumns(
        {
            "venue": F.when(k % 3 == 1, "Elsevier BV").when(k % 3 == 2, "ICML Workshop on Y"), "arxiv_id": F.lit("cs/9901001"),
            "authors": F.when(k % 4 == 0, F.array(F.lit("Kim et al."))).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("A B"), F.lit("C D"))), "title": F.when(k % 5 == 0, "A <i>title</i>").otherwise(F.col("title")),
        }
    )
    return maintain.audit(rows, AS_OF)


@query(
    f"""WITH e AS ({ENTRIES}) SELECT key, array_to_string(list_filter([CASE WHEN key % 2 = 0 THEN 'citations ' || citation_count || ' -> ' || (citation_count + 5) END, CASE WHEN key % 3 = 0 THEN 'doi 10.1000/' || key END,
CASE WHEN key % 5 = 0 THEN 'venue arXiv -> ICML' END, CASE WHEN key % 7 = 0 THEN 'abstract' END], lambda x: x IS NOT NULL), '; ') AS changes FROM e"""
)
def refresh_diff(spark, sf_dir):
    """What fresh records change in stored ones."""
    k, none = F.col("key"), F.lit(None).cast("string")
    refs = F.array().cast("array<string>")
    stored = entries(spark, sf_dir).select("key", "citation_count", refs.alias("references"), none.alias("doi"), F.lit("arXiv").alias("venue"), F.lit("@misc{}").alias("bibtex"), none.alias("abstract"))
    fresh = stored.withColumns({"citation_count": F.col("citation_count") + F.when(k % 2 == 0, 5).otherwise(0), "doi": F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), k.cast("string"))), "venue": F.when(k % 5 == 0, "ICML").otherwise("bioRxiv"), "abstract": F.when(k % 7 == 0, "text")})
    return maintain.refreshed(stored, fresh).select("key", F.array_join("changes", "; ").alias("changes"))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 10 = 3 THEN 'skipped' WHEN c_custkey % 2 = 1 THEN 'added' WHEN c_custkey % 4 = 0 THEN 'skipped' WHEN c_custkey % 6 = 0 THEN 'skipped' ELSE 'updated' END AS outcome,
CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'mine' ELSE 'mine' || chr(10) || chr(10) || '### Notes from import' || chr(10) || chr(10) || 'theirs' END ELSE CASE WHEN c_custkey % 6 = 3 THEN 'mine' ELSE 'theirs' END END AS notes
FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT '../' || c_custkey, 'skipped', CASE WHEN c_custkey % 6 = 3 THEN 'mine' ELSE 'theirs' END FROM customer WHERE c_custkey % 10 = 3"""
)
def import_merge(spark, sf_dir):
    """Two libraries merged, newer wins: stale, unread and unsafe entries are skipped, notes are joined."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    base = _t(spark, sf_dir, "customer").select(k.alias("n"), F.col("c_name").alias("title"), none.alias("doi"), none.alias("arxiv_id"), F.lit("2020-01-01").alias("added"))
    n, name = F.col("n"), F.col("n").cast("string")
    mine = base.where("n % 2 = 0").select(name.alias("key"), "title", "doi", "arxiv_id", "added", F.when(n % 6 == 0, "verified").otherwise("unread").alias("status"), F.when(n % 4 == 0, "2021-06-01").otherwise("2020-06-01").alias("updated"), F.lit("mine").alias("notes"))
    theirs = base.select(F.when(n % 10 == 3, F.concat(F.lit("../"), name)).otherwise(name).alias("key"), "title", "doi", "arxiv_id", "added", F.lit("unread").alias("status"), F.lit("2021-01-01").alias("updated"), F.when(n % 6 == 0, "mine").when(n % 6 == 3, "mine").otherwise("theirs").alias("notes"))
    return maintain.imported(mine, theirs).select("key", "outcome", "notes")


@query(
    """SELECT event_id AS key, CASE WHEN event_id % 7 = 0 THEN 'insert' WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 5 = 0 THEN 'update' ELSE 'unchanged' END AS change FROM events"""
)
def index_sync_diff(spark, sf_dir):
    """Two snapshots compared: inserted, changed, deleted, unchanged."""
    e, k = _t(spark, sf_dir, "events"), F.col("event_id")
    old = e.where(k % 7 != 0).select(k.alias("key"), F.col("value").alias("mtime"))
    new = e.where((k % 11 != 0) | (k % 7 == 0)).select(k.alias("key"), (F.col("value") + F.when(k % 5 == 0, 1.0).otherwise(1e-9)).alias("mtime"))
    return maintain.snapshot_diff(old, new)


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) FILTER (l_partkey % 2 = 0) AS linked FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey"""
)
def link_references(spark, sf_dir):
    """Orders whose references name parts that the library has."""
    l = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    none = F.lit(None).cast("string")
    ref = F.struct(F.concat(F.lit("work number "), F.col("l_partkey").cast("string")).alias("title"), none.alias("doi"), none.alias("arxiv_id"), none.alias("key"))
    citing = l.groupBy("l_orderkey").agg(F.collect_list(ref).alias("references")).select(F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("title"), "references")
    works = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("Work Number "), F.col("p_partkey").cast("string")).alias("title"), F.array().cast(citing.schema["references"].dataType).alias("references"))
    both = citing.unionByName(works).withColumns({"doi": none, "arxiv_id": none})
    return identity.link_references(both).where("key not like 'p%'").select("key", "linked")


@query(
    """WITH RECURSIVE e AS (SELECT l_partkey AS citing, CAST((l_partkey * 7 + l_suppkey * 13) % 2000 AS BIGINT) AS cited, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2),
w AS (SELECT p_partkey AS start, 0 AS hop, p_partkey AS node, [p_partkey] AS seen FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT start, hop + 1, cited, list_append(seen, cited) FROM (SELECT w.*, e.cited, row_number() OVER (PARTITION BY w.start ORDER BY e.d, e.cited) AS n FROM w JOIN e ON e.citing = w.node WHERE NOT list_contains(w.seen, e.cited) AND w.hop < 5) WHERE n = 1)
SELECT start, CAST(hop AS INTEGER) AS hop, node FROM w"""
)
def citation_chain(spark, sf_dir):
    """Five steps back from every fiftieth part, each to the oldest unvisited work."""
    cited = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 2000).alias("cited")
    links = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("citing"), cited).agg(F.min("l_shipdate").alias("d"))
    starts = _t(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))
    return citations.chains(starts, links, [F.col("d")])


@query(
    """SELECT p_partkey, '@article{k' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {Ann Lee and Bo Li},' || chr(10) || CASE WHEN p_size % 10 = 0 THEN '' ELSE '  year = {' || (1990 + p_size % 10) || '},' || chr(10) END || '  journal = {' || p_brand || '}' || chr(10) || '}' AS bibtex FROM part"""
)
def cite_bibtex(spark, sf_dir):
    """Parts as BibTeX."""
    none = F.lit(None).cast("string")
    year = F.when(F.col("p_size") % 10 != 0, 1990 + F.col("p_size") % 10)
    text = export.bibtex(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), F.lit("journal article"), F.col("p_name"), F.array(F.lit("Ann Lee"), F.lit("Bo Li")), year, F.col("p_brand"), none, none, none)
    return _t(spark, sf_dir, "part").select("p_partkey", text.alias("bibtex"))


@query("SELECT s_suppkey, 'Ann Lee et al., ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ', 2001' ELSE '' END AS citation FROM supplier")
def cite_text(spark, sf_dir):
    """'First et al., Venue, Year'."""
    year = F.when(F.col("s_suppkey") % 2 == 0, 2001)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", export.citation(F.array(F.lit("Ann Lee"), F.lit("Bo Li")), F.col("s_name"), year).alias("citation"))


@query("SELECT conv_id, string_agg('### ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def sections_markdown(spark, sf_dir):
    """Conversations as the sections of an entry."""
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.col("text").alias("summary")))).alias("s"))
    return c.select("conv_id", export.sections_markdown(F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["summary"].alias("summary")))).alias("markdown"))


@query(
    """WITH n AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, round(max(t - n * 30.0) OVER (PARTITION BY user_id ORDER BY n) + n * 30.0 - t, 3) AS wait FROM n"""
)
def throttle_schedule(spark, sf_dir):
    """How long each user's events would wait to stand 30 seconds apart."""
    rows = _t(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return maintain.throttled(rows, 30.0, host="user_id").select("event_id", "wait")


@query(
    """WITH e AS (SELECT doc_id, substr(lower(regexp_replace(split_part(text, chr(10), 1), '[^a-zA-Z0-9]+', '', 'g')), 1, 200) AS s, doc_id % 3 <> 0 AS open FROM documents),
i AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN '10.5555/' || (page_id % 1000) END AS doi, lower(p_name) AS x FROM pages JOIN part ON p_partkey = page_id),
h AS (SELECT id, doc_id, CASE WHEN open THEN 1 ELSE 2 END AS way FROM i JOIN e ON doi = '10.5555/' || doc_id
UNION ALL SELECT id, doc_id, CASE WHEN e.open THEN 3 ELSE 4 END FROM (SELECT page_id AS id, (SELECT s FROM e WHERE doc_id = page_id) AS s FROM pages) q JOIN e USING (s) WHERE s <> '' AND id % 2 = 1)
SELECT id, key, CASE way WHEN 1 THEN 'unread by id' WHEN 2 THEN 'any by id' WHEN 3 THEN 'unread by title' ELSE 'any by title' END AS how FROM (SELECT id, min(way) AS way, arg_min('d' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), (way, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0'))) AS key FROM h GROUP BY id)"""
)
def inbox_match_cascade(spark, sf_dir):
    """Dropped files matched to entries by identifier, then by title; unread entries first."""
    none, d = F.lit(None).cast("string"), _t(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    library = d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"), F.concat(F.lit("10.5555/"), F.col("doc_id").cast("string")).alias("doi"), none.alias("arxiv_id"), F.regexp_replace(title, "[^\\x00-\\x7F]", "").alias("title"), F.when(F.col("doc_id") % 3 != 0, "unread").otherwise("verified").alias("status"))
    first = d.select(F.col("doc_id").alias("page_id"), F.regexp_replace(title, "[^\\x00-\\x7F]", "").alias("title"))
    items = _t(spark, sf_dir, "pages").join(first, "page_id", "left").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("10.5555/"), (F.col("page_id") % 1000).cast("string"))).alias("doi"), none.alias("arxiv_id"), F.when(F.col("page_id") % 2 == 1, F.col("title")).alias("title"), F.lit("").alias("stem"))
    return identity.match_cascade(items, library)


@query("SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Events in ten-minute windows: the batch form of the stream in ``quire.streaming``."""
    from quire.streaming.events import windowed_counts

    rows = windowed_counts(_t(spark, sf_dir, "events"), "10 minutes")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, sf_dir):
    """Sessions of users with gaps of half an hour."""
    from quire.streaming.events import sessions

    rows = sessions(_t(spark, sf_dir, "events"), "30 minutes")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT key, CASE level WHEN 'A*' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS rank, lrank <= 1 AS meets FROM ({ENTRIES})")
def level_ranks(spark, sf_dir):
    """Level ranks and the minimum test."""
    e = entries(spark, sf_dir)
    return e.select("key", searching.level_rank(F.col("level")).alias("rank"), searching.meets_level(F.col("level"), "A").alias("meets"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 3 IN (1, 2) AND p_size % 3 < p_size % 4 THEN (p_size % 3) || ' of ' || (p_size % 4) || ' pages (sampled)' ELSE (p_size % 4) || ' pages (complete)' END AS coverage FROM part"""
)
def coverage_text(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", export.coverage(F.col("p_size") % 4, F.col("p_size") % 3).alias("coverage"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' WHEN 2 THEN 'url' WHEN 3 THEN 'title' ELSE 'doi' END AS kind,
CASE p_partkey % 5 WHEN 0 THEN '2101.00001' WHEN 1 THEN '10.1000/x' || p_partkey WHEN 2 THEN 'https://example.org/' || p_partkey WHEN 3 THEN p_name ELSE '10.1234/abc' END AS value FROM part"""
)
def parse_targets(spark, sf_dir):
    """What users type, classified."""
    k = F.col("p_partkey").cast("string")
    raw = F.get(F.array(F.lit("arXiv:2101.00001v3"), F.concat(F.lit("https://doi.org/10.1000/X"), k), F.concat(F.lit("https://example.org/"), k), F.col("p_name"), F.lit("10.1234/ABC.")), (F.col("p_partkey") % 5).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(identifiers.target(raw))))


@query("SELECT p_partkey, array_to_string(list_filter([lower(split_part(p_name, ' ', 1)), CASE WHEN lower(replace(p_type, ' ', '-')) <> lower(split_part(p_name, ' ', 1)) THEN lower(replace(p_type, ' ', '-')) END, 'x-y'], lambda x: x <> ''), ',') AS tags FROM part")
def tag_rules(spark, sf_dir):
    """Tags lower-cased, hyphenated, each once."""
    p = _t(spark, sf_dir, "part")
    raw = F.array(F.upper(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))), F.concat(F.lit(" "), F.col("p_type")), F.lit("X y"), F.lit("x-Y-"), F.lit(" "))
    return p.select("p_partkey", F.array_join(identifiers.normal_tags(raw), ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 60)) || '…' END AS short FROM (SELECT doc_id, text AS f FROM documents)")
def short_titles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", texts.short(F.col("text")).alias("short"))
