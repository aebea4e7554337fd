"""The citation graph: edges, co-citation mining, expansion, pairs and bounded chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import identity, slug
from quire.sources.storage import staged

# Citing works that a candidate needs once a library has so many entries.
MIN_COCITATIONS, LIBRARY_SIZE = 2, 3
MAX_HOPS, MAX_NEXT = 5, 3
#: Pairs that a task counts, on average.
PAIRS_A_TASK = 2_000_000


def edges(entries: DataFrame) -> DataFrame:
    """citing, cited (identity), place and the reference's fields of every titled reference."""
    r = entries.select(F.col("key").alias("citing"), F.posexplode("references").alias("place", "r")).where(F.coalesce("r.title", F.lit("")) != "")
    return r.select("citing", "place", identity(F.col("r.doi"), F.col("r.arxiv_id"), F.col("r.title")).alias("cited"), "r.title", "r.authors", "r.year", "r.doi", "r.arxiv_id")


def cocited(links: DataFrame, *, citing: str = "citing", cited: str = "cited", least: int | None = None) -> DataFrame:
    """cited, cocitations: distinct citing works of each cited one, at least the threshold of the library's size."""
    once = links.select(citing, cited).distinct()
    if least is None:
        # The limit lets the count stop early.
        least = MIN_COCITATIONS if once.select(citing).distinct().limit(LIBRARY_SIZE).count() >= LIBRARY_SIZE else 1
    return once.groupBy(F.col(cited).alias("cited")).agg(F.count("*").alias("cocitations")).where(F.col("cocitations") >= least)


def mine_references(entries: DataFrame) -> DataFrame:
    """Cited works that the library lacks, most cited and newest first; fields come from the first reference in key order."""
    # Links and identities are read several times, and entries may be dear to compute.
    links = staged(edges(entries), "cited-links")
    held = staged(entries.select(identity(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("cited"), slug(F.col("title"), 120).alias("_slug")), "cited-known")
    counts = cocited(links, least=MIN_COCITATIONS if held.limit(LIBRARY_SIZE).count() >= LIBRARY_SIZE else 1)
    proto = links.groupBy("cited").agg(F.min_by(F.struct("title", "authors", "year", "doi", "arxiv_id"), F.struct("citing", "place")).alias("p"))
    known, titles = held.select("cited").distinct(), held.select("_slug").distinct()
    rows = counts.join(known, "cited", "left_anti").join(proto, "cited").select("cited", "cocitations", "p.*").withColumn("_slug", slug(F.col("title"), 120))
    return rows.join(titles, "_slug", "left_anti").drop("_slug").orderBy(F.col("cocitations").desc(), F.coalesce("year", F.lit(0)).desc(), "cited")


def expansion(links: DataFrame, limit: int, *, citing: str = "citing", cited: str = "cited", known: DataFrame | None = None) -> DataFrame:
    """cited, n: references counted with repeats; two are needed where more than two works cite; the first ``limit``."""
    sources = links.select(citing).distinct().limit(3).count()
    counts = links.groupBy(F.col(cited).alias("cited")).agg(F.count("*").alias("n")).where(F.col("n") >= (2 if sources > 2 else 1))
    if known is not None:
        counts = counts.join(known, "cited", "left_anti")
    return counts.orderBy(F.col("n").desc(), "cited").limit(limit)


def cocitation_pairs(links: DataFrame, *, citing: str = "citing", cited: str = "cited", least: int = 2, limit: int | None = None) -> DataFrame:
    """a, b, n: works cited together by at least ``least`` works. Only cited works with that many citers can pair."""
    once = links.select(F.col(citing).alias("citing"), F.col(cited).alias("cited")).distinct()
    often = once.groupBy("cited").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("cited")
    once = staged(once.join(often, "cited", "left_semi"), "cocited")
    # Most pairs come once, so none are counted before they are brought together, and the number of parts grows with theirs.
    made = once.groupBy("citing").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    parts = max(once.sparkSession.sparkContext.defaultParallelism, math.ceil(made / PAIRS_A_TASK))
    pairs = once.withColumnRenamed("cited", "a").join(once.withColumnRenamed("cited", "b"), "citing").where("a < b").select("a", "b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return pairs.orderBy(F.col("n").desc(), "a", "b").limit(limit) if limit else pairs


def chains(starts: DataFrame, links: DataFrame, order: list[Column], *, max_hops: int = MAX_HOPS) -> DataFrame:
    """start, hop, node: from each start to the best next work by ``order``, at most ``max_hops`` steps, never in a circle.

    Links have citing, cited and what ``order`` needs. A walk ends where no unvisited work is cited. All starts walk
    at once; each step is one join and one window, written out so that the lineage stays short.
    """
    best = Window.partitionBy("start").orderBy(*order, "cited")
    # Every hop reads the links: they are computed once.
    links = staged(links, "chain-links")
    front = staged(starts.select(F.col("node").alias("start"), F.lit(0).alias("hop"), F.col("node"), F.array("node").alias("seen")).distinct(), "chain")
    out = front.select("start", "hop", "node")
    for hop in range(1, max_hops + 1):
        step = front.join(links, front["node"] == links["citing"]).where(~F.array_contains("seen", F.col("cited")))
        step = step.withColumn("_n", F.row_number().over(best)).where("_n = 1")
        front = staged(step.select("start", F.lit(hop).alias("hop"), F.col("cited").alias("node"), F.concat("seen", F.array("cited")).alias("seen")), "chain")
        out = out.unionByName(front.select("start", "hop", "node"))
        if not front.limit(1).count():
            break
    return out


def next_references(attributed: DataFrame, limit: int = MAX_NEXT) -> DataFrame:
    """The references that a reading blames for a claim: by confidence (0.5 if not given), first of equal works, at most ``limit``.

    ``attributed`` has node, ord, confidence, title, doi and arxiv_id.
    """
    who = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("arxiv_id", F.lit("")), F.lower("title"))
    rows = attributed.withColumns({"_who": who, "confidence": F.coalesce("confidence", F.lit(0.5))})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("node", "_who").orderBy(F.col("confidence").desc(), "ord"))).where("_n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("confidence").desc(), "ord"))).where(F.col("place") <= limit)
    return rows.drop("_who", "_n")


def best_next(candidates: DataFrame) -> DataFrame:
    """Of each node's readable candidates that state the claim the origin, else the oldest, else the first."""
    order = Window.partitionBy("node").orderBy(F.col("is_origin").desc(), F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)), "ord")
    return candidates.where("readable and states_claim").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def hop_label(authors: Column, year: Column) -> Column:
    """'Surname et al. (year)'."""
    last = F.try_element_at(F.split(F.get(authors, F.lit(0)), r"\s+"), F.lit(-1))
    return F.concat(F.coalesce(last, F.lit("Unknown")), F.when(F.size(authors) > 1, " et al.").otherwise(""), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def chain_text(hops: DataFrame) -> DataFrame:
    """start, chain: the labels of each walk joined by arrows."""
    return hops.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "label"))), lambda x: x["label"]), " -> ").alias("chain"))
