"""Queries of the segmented index over whole texts, beside the SQL of a full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.segments import SegmentedIndex
from quire.plans.tables import query
from quire.plans.tables import table as _t
from quire.sources.storage import fresh_path

CHANGED_TERMS = ["thing", "onthe", "ered", "quela"]
BLOCK_TERMS = ["the", "que", "thtion", "inder", "erthe"]
#: Shorter documents are deleted by the last batch.
LEAST_CHARS = 200


def scores_sql(terms: list[str], where: str = "true", more: str = "") -> str:
    """BM25 of four decimals more than a tie needs, over a full scan."""
    quoted = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE {where}),
w AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens, avg(len(t)) AS mean FROM l),
p AS (SELECT doc_id, term, n, count(*) AS f FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM l) WHERE term IN ({quoted}) GROUP BY ALL),
d AS (SELECT term, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, w GROUP BY term, docs)
SELECT doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score{more}
FROM p JOIN d USING (term), w GROUP BY ALL ORDER BY score, doc_id LIMIT 50
"""


def _index(spark, payload: tuple[str, ...] = ()) -> SegmentedIndex:
    return SegmentedIndex(spark, fresh_path(spark, "segments"), {"text": 1.0}, payload=payload)


def _best(index: SegmentedIndex, terms: list[str], mean: float | None = None) -> DataFrame:
    return index.top(terms, 50, digits=6, mean=mean).select(F.col("key").alias("doc_id"), "score")


@query(scores_sql(CHANGED_TERMS, f"coalesce(length(text), 0) >= {LEAST_CHARS}", ", docs, tokens, (SELECT count(*) + count(*) FILTER (doc_id % 3 = 1) FROM documents) AS tokenised").replace("regexp_extract_all(lower(text)", "regexp_extract_all(lower(coalesce(text, ''))"))
def incremental_index(spark, sf_dir):
    """The best 50 documents after three batches: drafts and whole texts, then the other texts, then deletions.

    Every document comes in; one in three comes as its first line and is replaced by its text later. ``tokenised`` counts
    the documents whose terms were made: each new or changed version once, none for a deletion.
    """
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    turn, index = F.col("key") % 3, _index(spark)
    draft = F.when(turn == 1, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    first = index.apply(docs.where(turn < 2).withColumn("text", draft))
    second = index.apply(docs.where(turn > 0))
    last = index.apply(docs.limit(0), docs.where(F.coalesce(F.length("text"), F.lit(0)) < LEAST_CHARS).select("key"))
    made = first.segments[-1].docs + second.segments[-1].docs
    return _best(index, CHANGED_TERMS).select("doc_id", "score", F.lit(last.docs).cast("long").alias("docs"), F.lit(last.tokens).cast("long").alias("tokens"), F.lit(made).cast("long").alias("tokenised"))


@query(scores_sql(BLOCK_TERMS))
def block_max_search(spark, sf_dir):
    """The best 50 documents for five terms, frequent ones among them, from the blocks that can hold one.

    A document without text counts as a document, but not in the mean length.
    """
    index = _index(spark, ("written",))
    m = index.apply(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("text").isNotNull().alias("written")))
    written = index.documents(m).where("written").count() if m.segments else 0
    return _best(index, BLOCK_TERMS, m.tokens / written if written else None)
