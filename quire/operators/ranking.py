"""Candidate pools: merging sources, windows, triage, quotas, scores and the final rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import identity

# Weights and limits of the candidate scores.
RELEVANCE, IMPORTANCE, LEAST_RELEVANCE, ASSUMED_RELEVANCE = 0.65, 0.35, 0.35, 0.5
WORLD, LOCAL, ASSUMED_WORLD = 0.7, 0.3, 0.35
VENUE_POINTS = {"A*": 1.0, "A": 0.8, "B": 0.55, "C": 0.3}
OTHER_POINTS, FULL_VELOCITY, RECENT_YEARS, QUOTA = 0.4, 100.0, 2, 0.3
FACETS = ("relevance", "foundational", "recent", "surveys", "preprints")
SHORTEST_TITLE = 6


def pool_cap(limit: int) -> int:
    return max(40, 4 * limit)


def mined_intake(limit: int) -> int:
    return max(20, 2 * limit)


def velocity_score(per_year: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(1 + F.greatest(per_year, F.lit(0.0))) / F.log10(F.lit(1 + FULL_VELOCITY)))


def venue_score(level: Column) -> Column:
    points = F.lit(OTHER_POINTS)
    for name, value in VENUE_POINTS.items():
        points = F.when(level == name, value).otherwise(points)
    return F.when(level.isNotNull(), points)


def world_score(velocity: Column, venue: Column, year: Column, as_of_year: int) -> Column:
    """Velocity and venue weighed; a recent work's velocity says nothing; either stands alone if the other is missing."""
    recent = F.coalesce(year >= as_of_year - RECENT_YEARS, F.lit(False))
    both = 0.6 * velocity + 0.4 * venue
    return F.when(recent & venue.isNotNull(), venue).when(recent, F.lit(None).cast("double")).otherwise(F.coalesce(both, velocity, venue))


def local_score(cocitations: Column, angles: Column) -> Column:
    return 0.6 * F.least(F.lit(1.0), cocitations / 3) + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0), angles - 1) / 2)


def importance(world: Column, local: Column) -> Column:
    return F.least(F.lit(1.0), WORLD * F.coalesce(world, F.lit(ASSUMED_WORLD)) + LOCAL * local)


def rank_score(relevance: Column, importance_: Column) -> Column:
    return RELEVANCE * F.coalesce(relevance, F.lit(ASSUMED_RELEVANCE)) + IMPORTANCE * importance_


def corroborated(cocitations: Column, angles: Column) -> Column:
    return (cocitations > 0) | (angles > 1)


def within_window(year: Column, low: int | None, high: int | None) -> Column:
    """A plan's year window; a missing year passes."""
    return year.isNull() | (F.lit(low is None) | (year >= (low or 0))) & (F.lit(high is None) | (year <= (high or 9999)))


def interleaved(rows: DataFrame, *, source: str = "source", place: str = "place", who: str = "who") -> DataFrame:
    """Ranked lists dealt in turn, each work once, where it comes first; adds ``position`` from 1. Blank works are skipped."""
    rows = rows.where(F.coalesce(who, F.lit("")) != "")
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(source).orderBy(place)))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(who).orderBy("_turn", source))).where("_n = 1").drop("_n")
    # A pool is a few hundred rows; one order over all of it is what the caller asks for.
    return first.withColumn("position", F.row_number().over(Window.orderBy("_turn", source))).drop("_turn")


def absorbed(candidates: DataFrame) -> DataFrame:
    """One row a work: first filled fields by arrival, angles united in order, most co-citations, source 'both' if several."""
    who = identity(F.col("doi"), F.col("arxiv_id"), F.col("title"))
    rows = candidates.withColumn("dedup_key", who)
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c)
    angles = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "angles"))), lambda x: x["angles"]))).alias("angles")
    source = F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source")
    fields = [early(c) for c in ("title", "authors", "year", "venue", "doi", "arxiv_id", "url", "why", "citation_count") if c in candidates.columns]
    return rows.groupBy("dedup_key").agg(F.min("arrival").alias("arrival"), *fields, angles, F.max(F.coalesce("cocitations", F.lit(0))).alias("cocitations"), source)


def trimmed(candidates: DataFrame, cap: int, *, strong: Column, order: list[Column], quota: float = QUOTA) -> DataFrame:
    """At most ``cap`` rows: a share is kept for uncorroborated ones, and either side fills up what the other leaves."""
    place = F.row_number().over(Window.partitionBy("_strong").orderBy(*order))
    rows = candidates.withColumn("_strong", strong).withColumn("_place", place)
    counts = rows.agg(F.count_if("_strong").alias("_s"), F.count_if(~F.col("_strong")).alias("_w"))
    reserved = F.least(F.col("_w"), F.bround(F.lit(cap * quota)).cast("long"))
    take = counts.select("_s", "_w", F.greatest(reserved, F.lit(cap) - F.col("_s")).alias("_solo"), reserved.alias("_r"))
    rows = rows.join(F.broadcast(take))  # one row of totals
    room = F.when(F.col("_strong"), F.greatest(F.lit(cap) - F.col("_r"), F.lit(cap) - F.col("_w"))).otherwise(F.col("_solo"))
    return rows.where((F.col("_place") <= room) | (F.col("_s") + F.col("_w") <= cap)).drop("_strong", "_place", "_s", "_w", "_solo", "_r")


def triage(angles: Column, cocitations: Column, year: Column) -> list[Column]:
    return [(angles + cocitations).desc(), F.coalesce(year, F.lit(0)).desc()]


def ranked(candidates: DataFrame, limit: int, as_of_year: int) -> DataFrame:
    """Scores and the best rows; those that a judge found irrelevant are out."""
    age = F.greatest(F.lit(as_of_year) - F.col("year"), F.lit(1))
    rows = candidates.withColumns({"velocity": velocity_score(F.col("citation_count") / age), "venue_points": venue_score(F.col("level")), "local": local_score(F.col("cocitations"), F.size("angles"))})
    rows = rows.withColumn("importance", importance(world_score(F.col("velocity"), F.col("venue_points"), F.col("year"), as_of_year), F.col("local")))
    rows = rows.withColumn("rank", rank_score(F.col("relevance"), F.col("importance"))).where(F.col("relevance").isNull() | (F.col("relevance") >= LEAST_RELEVANCE))
    return rows.orderBy(F.col("rank").desc(), F.coalesce("year", F.lit(0)).desc(), "dedup_key").limit(limit)


def with_relevance(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """A judge's scores by dedup_key, between 0 and 1."""
    one = scores.groupBy("dedup_key").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("score"))).alias("relevance"))
    return candidates.drop("relevance").join(one, "dedup_key", "left")


def enriched(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Metrics of candidates that lack citations or venue, from records by identifier; a record is used by the first candidate only.

    Title-matched records give metrics and never an identity.
    """
    ident = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("arxiv_id", F.lit("")))
    pending = F.col("citation_count").isNull() | F.col("venue").isNull()
    rows = candidates.withColumn("_ident", F.when(pending, ident))
    # Rows that need nothing have no identifier here and are dealt by arrival, not to one task.
    first = F.row_number().over(Window.partitionBy("_ident", F.when(F.col("_ident").isNull(), F.col("arrival"))).orderBy("arrival"))
    rows = rows.withColumn("_mine", F.col("_ident").isNotNull() & (first == 1))
    r = records.select(F.col("work").alias("_work"), *[F.col(c).alias(f"_r_{c}") for c in ("citation_count", "venue", "year", "doi", "arxiv_id", "title_matched")])
    joined = rows.join(r, F.col("_mine") & (rows["_ident"] == r["_work"]), "left")
    own = ~F.coalesce("_r_title_matched", F.lit(False))
    out = {c: F.coalesce(c, f"_r_{c}") for c in ("citation_count", "venue", "year")} | {c: F.coalesce(F.col(c), F.when(own, F.col(f"_r_{c}"))) for c in ("doi", "arxiv_id")}
    return joined.withColumns(out).select(*candidates.columns)
