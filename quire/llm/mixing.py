"""Mixing sources to target weights by capped water-filling.

Sources share the wanted total by weight; a source whose share exceeds ``max_epochs`` times its size is clamped there
and the excess goes to the others by weight, again and again until nothing exceeds. Each source then takes all its
documents a whole number of times and a seeded part of them once more: documents are ordered by an MD5 of seed, id and
the MD5 of their text, so an id that many rows share (or null) is no hot key, and those whose middle lies below the fractional target are taken. That cut is found by sums over the first three and
the next three hex digits of the MD5 (4096 cells each), so no source is ever sorted in one task: only the documents of
one cell of one cell are ordered, and the driver sees two numbers a round.

Defined results: a null text has size 0; null is a source of its own and comes last; a null id and a null text hash as empty ones;
repeated rows are ordered side by side and decided one by one; a source without words gets target 0; an empty table
gives an empty result; columns of the input named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import staged, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "quire-mix"
#: Source tables of up to this many rows are broadcast.
BROADCAST_SOURCES = 100_000
DIGITS = 3


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the given ones in turn over the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int")))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to sources (source, source_size, weight): the level of water times the weight, capped."""
    cap = F.col("source_size") * float(max_epochs)
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * float(first[0] or 0)
    level = total / first[1] if first[1] else 0.0
    while True:
        full = F.col("weight") * level >= cap
        r = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not r[1]:
            level = float("inf")
            break
        after = (total - (r[0] or 0.0)) / r[1]
        if after <= level:
            break
        level = after
    if level == float("inf"):
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.least(cap, F.col("weight") * level).cast("double"))


def _small(side: DataFrame, n: int) -> DataFrame:
    return F.broadcast(side) if n <= BROADCAST_SOURCES else side


def _cut(sums: DataFrame, start: Column, names: tuple[str, str]) -> DataFrame:
    """Of each source the cell in which its fractional target lies, and the words before that cell."""
    end = F.sum("_s").over(Window.partitionBy("source").orderBy("_cell"))
    sums = sums.withColumn("_end", start + end).where(F.col("_end") > F.col("_part"))
    return sums.groupBy("source").agg(F.min_by(F.struct("_cell", (F.col("_end") - F.col("_s")).alias("_start")), "_cell").alias("_c")).select("source", F.col("_c._cell").alias(names[0]), F.col("_c._start").alias(names[1]))


def mix(docs: DataFrame, *, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """All of ``docs`` with size, source_size, target and ``copies``, the times that the mix takes the document."""
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    base = docs.select(*given, F.size(words(F.col("text"))).cast("long").alias("size"), hashed.alias("_h"))
    facts = staged(base.select("source", "doc_id", "size", "_h"), "mix-rows")
    cell = lambda k: F.substring("_h", 1 + k * DIGITS, DIGITS)
    sums = staged(facts.groupBy("source", cell(0).alias("_cell")).agg(F.sum("size").alias("_s")), "mix-sums")
    sources = staged(cyclic_weights(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), weights), "mix-sources")
    n = sources.count()
    plan = water_fill(sources, share, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(_small(right, n), left["source"].eqNullSafe(right["_source"]), how).drop("_source")

    first = _cut(matched(sums, plan.select("source", "_part")), F.lit(0), ("_c1", "_s1"))
    plan = staged(matched(plan, first, "left"), "mix-first")
    inner = matched(facts, plan.select("source", "_part", "_c1", "_s1")).where(cell(0) == F.col("_c1"))
    inner = inner.groupBy("source", "_part", "_s1", cell(1).alias("_cell")).agg(F.sum("size").alias("_s"))
    plan = staged(matched(plan, _cut(inner, F.col("_s1"), ("_c2", "_s2")), "left"), "mix-second")
    rows = matched(base, plan.drop("weight"))
    a, b = cell(0), cell(1)
    inside = F.coalesce((a == F.col("_c1")) & (b == F.col("_c2")), F.lit(False))
    below = F.coalesce((a < F.col("_c1")) | (a == F.col("_c1")) & (b < F.col("_c2")), F.lit(False))
    # What one cell of a cell holds is 1 / 16,777,216 of its source; only that is ordered row by row.
    edge = rows.where(inside)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("_h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    edge = edge.withColumn("_more", (2 * (F.col("_s2") + before) + F.col("size") <= 2 * F.col("_part")).cast("long"))
    rest = rows.where(~inside).withColumn("_more", below.cast("long"))
    out = rest.unionByName(edge).withColumn("copies", F.col("_whole") + F.col("_more"))
    return out.select(*given, "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows = mix(docs, **options).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The digest of the contract, one row a document."""
    rows = mix(docs.select("doc_id", "text", "source"), **options)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w,
              2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS r, (SELECT 1.5::DOUBLE * sum(source_size) FROM s0) AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM s2),
s4 AS (SELECT *, (SELECT lam FROM s3 WHERE lam <= r ORDER BY r, source LIMIT 1) AS level FROM s3),
s5 AS (SELECT source, source_size, least(cap, w * level) AS target FROM s4),
s6 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM s5),
x AS (SELECT d.doc_id, d.size, s6.source_size, s6.target, s6.whole, s6.target - s6.whole * s6.source_size AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND 2 * c + size <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
