"""Weighted BM25 search over an inverted index, with structured filters and the listing of a blank query.

The index is three DataFrames that can be stored: ``postings`` (term, key, field weight sum, frequency), ``lengths``
(key, tokens) and two scalars. A query's terms are a handful of rows on the driver, so they reach the postings as a
filter that the scan can use; nothing is joined but the matching postings.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import ascii_fold, latin_fold
from quire.functions.stemming import porter_stems
from quire.schema import LEVELS

# Words that searches drop, the weights of an entry's fields, BM25's constants.
STOPWORDS = frozenset(
    "a an the of in on for and or to is are what which how does do can with by from at be been was were that this these those it its as we you i about into there s".split()
)
FIELD_WEIGHTS = {"title": 8.0, "authors": 2.0, "one_liner": 6.0, "abstract": 2.0, "tags": 4.0, "summary": 1.0, "findings": 3.0, "notes": 5.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = "([a-z0-9]+)"
#: Tokens and query words of folded text: letters and digits of any script.
FOLDED_TOKEN = r"([\p{L}\p{N}]+)"
QUERY_WORD, FOLDED_QUERY_WORD = r"[A-Za-z0-9][A-Za-z0-9_+#.-]*", "[^\\W_][\\w+#.\u0300-\u036f-]*"
_MORE_FROM, _MORE_TO = latin_fold(0x1E00, 0x1F00)


def query_parts(query: str, word: str = QUERY_WORD) -> tuple[list[str], list[str]]:
    """(phrases, terms) of what a user typed: quoted phrases as they are, other words without stopwords, in order."""
    query = (query or "").strip()
    phrases = [p for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    found = re.findall(word, re.sub(r'"[^"]*"', " ", query))
    return phrases, list(dict.fromkeys(w for w in found if len(w) > 1 and w.lower() not in STOPWORDS))


def match_expression(query: str) -> str:
    """The full-text expression of a query: quoted parts joined by OR."""
    phrases, terms = query_parts(query)
    return " OR ".join(f'"{p}"' for p in [*phrases, *terms])


def match_column(query: Column) -> Column:
    """``match_expression`` of a column."""
    q = F.trim(F.coalesce(query, F.lit("")))
    phrases = F.filter(F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.trim(p) != "")
    words = F.regexp_extract_all(F.regexp_replace(q, '"[^"]*"', " "), F.lit("([A-Za-z0-9][A-Za-z0-9_+#.-]*)"), F.lit(1))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*sorted(STOPWORDS))))
    return F.array_join(F.transform(F.concat(phrases, words), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR ")


def entry_fields(entries: DataFrame, *more: str) -> DataFrame:
    """key and the indexed fields of entries as text, and more columns as they are."""
    joined = lambda c: F.concat_ws(", ", c)
    return entries.select(
        "key", F.coalesce("title", F.lit("")).alias("title"), joined("authors").alias("authors"), F.coalesce("one_liner", F.lit("")).alias("one_liner"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        joined("tags").alias("tags"), F.array_join(F.transform("sections", lambda s: F.concat(F.lit("### "), s["name"], F.lit("\n\n"), s["summary"])), "\n\n").alias("summary"), joined("key_findings").alias("findings"), F.coalesce("notes", F.lit("")).alias("notes"),
        *more,
    )


def tokens(text: Column, *, fold: bool = False, stem: bool = False, token: str = TOKEN) -> Column:
    """The terms of a text in order; with ``fold`` without accents and in any script, with ``stem`` as Porter's stems."""
    text = F.translate(ascii_fold(text), _MORE_FROM, _MORE_TO) if fold else F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(text), F.lit(FOLDED_TOKEN if fold and token == TOKEN else token), F.lit(1))
    return porter_stems(found) if stem else found


class Index:
    """An inverted index: postings (term, key, f: weighted frequency, places) and lengths (key, n).

    ``fold`` and ``stem`` tell how its terms were made; a query's terms are made in the same way.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, *, fold: bool = False, stem: bool = False):
        self.postings, self.lengths, self.fold, self.stem = postings, lengths, fold, stem

    @classmethod
    def build(cls, rows: DataFrame, weights: dict[str, float], *, key: str = "key", positions: bool = False, token: str = TOKEN, fold: bool = False, stem: bool = False) -> Index:
        """Indexes the columns named in ``weights``. With ``positions`` phrases can be matched."""
        terms = lambda c: tokens(F.col(c), fold=fold, stem=stem, token=token)
        fields = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("field"), terms(c).alias("t")) for i, (c, w) in enumerate(weights.items())])
        spread = rows.select(F.col(key).alias("key"), F.explode(fields).alias("f")).select("key", "f.w", "f.field", F.posexplode("f.t").alias("at", "term"))
        extra = [F.sort_array(F.collect_list(F.struct("field", "at"))).alias("places")] if positions else []
        postings = spread.groupBy("term", "key").agg(F.sum("w").alias("f"), *extra)
        lengths = rows.select(F.col(key).alias("key"), sum((F.size(terms(c)) for c in weights), F.lit(0)).cast("long").alias("n"))
        return cls(postings, lengths, fold=fold, stem=stem)

    def save(self, path: str) -> None:
        """Postings lie sorted by term, so a query reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        made = self.lengths.sparkSession.range(1).select(F.lit(self.fold).alias("fold"), F.lit(self.stem).alias("stem"))
        made.write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        try:
            made = spark.read.parquet(f"{path}/terms").first().asDict()
        except AnalysisException:  # saved before terms could be folded or stemmed
            made = {}
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), **made)

    def phrase_hits(self, phrase: list[str], weights: list[float]) -> DataFrame:
        """key, f of documents that hold the tokens in a row within a field."""
        hit = self.postings.where(F.col("term") == phrase[0]).select("key", F.explode("places").alias("p")).select("key", "p.field", "p.at")
        for i, t in enumerate(phrase[1:], 1):
            step = self.postings.where(F.col("term") == t).select("key", F.explode("places").alias("p")).select("key", "p.field", (F.col("p.at") - i).alias("at"))
            hit = hit.join(step, ["key", "field", "at"])
        return hit.groupBy("key").agg(F.sum(F.get(F.array(*[F.lit(w) for w in weights]), F.col("field"))).alias("f"))

    def scores(self, terms: list[str], phrases: list[list[str]] | None = None, weights: list[float] | None = None) -> DataFrame:
        """key, score of every document that holds a term or phrase; lower is better."""
        hits = self.postings.where(F.col("term").isin(terms)).select(F.col("term").alias("part"), "key", "f")
        for p in phrases or []:
            hits = hits.unionByName(self.phrase_hits(p, weights or [1.0]).select(F.lit(" ".join(p)).alias("part"), "key", "f"))
        frequency = hits.groupBy("part").agg(F.count("*").alias("df"))
        whole = self.lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        # One row for each part of the query and one row of totals: both are broadcast.
        idfs = frequency.join(F.broadcast(whole)).select("part", idf.alias("idf"), "mean")
        rows = hits.join(F.broadcast(idfs), "part").join(self.lengths, "key")
        part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        return rows.groupBy("key").agg((-F.sum(part)).alias("score"))


def level_rank(level: Column) -> Column:
    """A* 0 to unranked 4; null as unranked, anything else 5."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(level, F.lit("unranked"))), F.lit(0).cast("long")) - 1, F.lit(5).cast("long")).cast("int")


def meets_level(level: Column, least: str | None) -> Column:
    if least in (None, "", "any"):
        return F.lit(True)
    return level_rank(level) <= level_rank(F.lit(least))


def matching(entries: DataFrame, *, level: str | None = None, tag: str | None = None, year_from: int | None = None, year_to: int | None = None, status: str | None = None, entry_type: str | None = None) -> DataFrame:
    """Entries that pass the filters. A year bound excludes rows without a year; a bound of 0 is none."""
    keep = meets_level(F.col("level"), level) if level else F.lit(True)
    if tag:
        keep = keep & F.array_contains(F.transform("tags", F.lower), tag.lower())
    if year_from:
        keep = keep & (F.col("year") >= year_from)
    if year_to:
        keep = keep & (F.col("year") <= year_to)
    if status:
        keep = keep & (F.col("status") == status)
    if entry_type:
        keep = keep & (F.col("type") == entry_type)
    return entries.where(keep)


def listing_score(level: Column, year: Column) -> Column:
    """The order of a blank query: level first, then year; a missing year counts as 0."""
    return (level_rank(level) * 1000 - F.coalesce(year, F.lit(0))).cast("double")


def search(entries: DataFrame, query: str, *, limit: int = 20, index=None, stem: bool | None = None, **filters) -> DataFrame:
    """key, title, score of the best entries, ties by key. Accents and word forms do not matter; with ``stem=False`` forms do.

    ``index`` is an ``Index`` or a ``SegmentedIndex``; the latter scores words without phrases from the blocks that can matter.
    """
    if index and stem is not None and stem != index.stem:
        raise ValueError("the index was built with another stem option")
    fold, stem = (index.fold, index.stem) if index else (True, stem is not False)
    phrases, terms = query_parts(query, FOLDED_QUERY_WORD if fold else QUERY_WORD)
    kept = matching(entries, **filters)
    if not phrases and not terms:
        return kept.select("key", "title", listing_score(F.col("level"), F.col("year")).alias("score")).orderBy("score", "key").limit(limit)
    # The index's own expression makes the query's terms, on one row.
    made = entries.sparkSession.range(1).select(*[tokens(F.lit(t), fold=fold, stem=stem).alias(f"t{i}") for i, t in enumerate([*terms, *phrases])]).first()
    single = sorted({x[0] for x in made if len(x) == 1})
    rows = [list(x) for x in dict.fromkeys(map(tuple, made)) if len(x) > 1]
    index = index or Index.build(entry_fields(entries), FIELD_WEIGHTS, positions=bool(rows), fold=fold, stem=stem)
    if not isinstance(index, Index):
        if not rows:
            allowed = kept.select("key") if any(v is not None for v in filters.values()) else None
            return index.top(single, limit, allowed).join(kept.select("key", "title"), "key").select("key", "title", "score").orderBy("score", "key")
        index = index.as_index()
    hits = index.scores(single, rows, list(FIELD_WEIGHTS.values()))
    return hits.join(kept.select("key", "title"), "key").select("key", "title", "score").orderBy("score", "key").limit(limit)


def reranked(hits: DataFrame, relevance: DataFrame | None, limit: int = 10) -> DataFrame:
    """Hits by a judge's relevance (key, relevance, why), first mention first; without one, in their own order."""
    if relevance is None:
        return hits.withColumn("relevance", F.lit(None).cast("double")).orderBy("score", "key").limit(limit)
    first = relevance.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("relevance").desc()))).where("_n = 1").drop("_n")
    return hits.join(first, "key").orderBy(F.col("relevance").desc(), "score", "key").limit(limit)


def listed(entries: DataFrame, *, sort: str = "level", limit: int = 200, **filters) -> DataFrame:
    """Entries for a listing: by level, year, title, cites or added."""
    rank, cites = level_rank(F.col("level")), F.coalesce("citation_count", F.lit(0))
    orders = {
        "level": [rank, F.coalesce("year", F.lit(0)).desc()],
        "year": [F.coalesce("year", F.lit(0)).desc()],
        "title": [F.lower("title")],
        "cites": [cites.desc()],
        "added": [F.coalesce("added", F.lit("")).desc()],
    }
    return matching(entries, **filters).orderBy(*orders[sort], "key").limit(limit)


def backlog(entries: DataFrame, *, missing: str = "reading", level: str | None = None, tag: str | None = None, limit: int = 0) -> DataFrame:
    """Entries without a reading (or a code link), best levels and most cited first."""
    lacks = F.col("status") != "verified" if missing == "reading" else F.coalesce("code_url", F.lit("")) == ""
    rows = matching(entries.where(lacks), level=level, tag=tag).orderBy(level_rank(F.col("level")), F.coalesce("citation_count", F.lit(0)).desc(), "key")
    return rows.limit(limit) if limit else rows
