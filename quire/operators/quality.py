"""Levels of works from venue rank and citation velocity, and a library's bar for admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.venues import is_workshop, let, venue_level
from quire.operators.search import meets_level

# Citations a year for each level, the landmark velocity of works without a venue, years of grace.
VELOCITY = (("A*", 100.0), ("A", 25.0), ("B", 5.0))
LANDMARK, GRACE = 200.0, 2


def citations_per_year(citations: Column, year: Column, as_of_year: int) -> Column:
    """Null where either is missing; a year of 0 is missing."""
    return F.when(year != 0, citations / F.greatest(F.lit(as_of_year) - year, F.lit(1)))


def assessed(venue: Column, kind: Column, year: Column, citations: Column, as_of_year: int, ranked: Column | None = None) -> Column:
    """struct(level, reason, needs_judgement); ``ranked`` is venue_level where it is known already."""
    return let(venue_level(venue) if ranked is None else ranked, lambda hit: _ladder(hit, venue, kind, year, citations, as_of_year))


def _ladder(hit: Column, venue: Column, kind: Column, year: Column, citations: Column, as_of_year: int) -> Column:
    age = F.when(year != 0, F.lit(as_of_year) - year)
    speed = citations_per_year(citations, year, as_of_year)
    soft = F.coalesce(kind.isin("workshop paper", "preprint"), F.lit(False)) | is_workshop(venue)
    verdict = lambda level, reason, judge=False: F.struct(level.alias("level") if isinstance(level, Column) else F.lit(level).alias("level"), reason.alias("reason"), F.lit(judge).alias("needs_judgement"))
    rate = F.format_string("%.0f citations/year", F.coalesce(speed, F.lit(0.0)))
    at = F.concat(F.lit("published at "), hit["name"], F.lit(" ("), hit["level"], F.lit(" venue)"))
    with_rate = F.concat(at, F.when(F.coalesce(speed, F.lit(0.0)) != 0, F.concat(F.lit("; "), rate)).otherwise(""))
    fast = F.when(speed >= VELOCITY[0][1], "A*").when(speed >= VELOCITY[1][1], "A").when(speed >= VELOCITY[2][1], "B")
    capped = F.when(soft & (fast == "A*") & (speed < LANDMARK), "A").otherwise(fast)
    label = F.when(kind == "preprint", "preprint").otherwise(F.coalesce(F.nullif(venue, F.lit("")), F.lit("unranked venue")))
    note = F.when(soft & (fast == "A*") & (speed >= LANDMARK), ", landmark").otherwise("")
    slow = F.format_string("%.1f citations/year after %d years", F.coalesce(speed, F.lit(0.0)), F.coalesce(age, F.lit(0)))
    measured = speed.isNotNull() & (age.isNull() | (age >= 1))
    return (
        F.when(hit.isNotNull() & ~soft & (hit["level"] == "A") & (speed >= VELOCITY[0][1]), verdict("A*", F.concat(at, F.lit("; "), rate)))
        .when(hit.isNotNull() & ~soft, verdict(hit["level"], with_rate))
        .when(measured & fast.isNotNull(), verdict(capped, F.concat(rate, F.lit(" ("), label, note, F.lit(")"))))
        .when(measured & (age > GRACE) & hit.isNotNull(), verdict("C", slow))
        .when(measured & (age > GRACE), verdict("C", F.concat(slow, F.lit(", venue not in the ranked list")), True))
        .when(age <= GRACE, verdict("unranked", F.concat(F.lit("published "), year.cast("string"), F.lit(" — too recent for citation metrics"), F.when(F.coalesce(venue, F.lit("")) != "", "; venue not in the ranked list").otherwise("; no venue")), True))
        .otherwise(verdict("unranked", F.lit("no ranked venue and no citation data"), True))
    )


def passes_bar(verdict: Column, kind: Column, least: str | None, allow_non_published: bool = False) -> Column:
    """struct(ok, why) by a library's policy."""
    out = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("why"))
    return (
        F.when((kind == "video") & F.lit(not allow_non_published), out(False, F.lit("non-published material (video)")))
        .when(verdict["needs_judgement"], out(True, F.lit("unranked but admitted (no metrics available yet)")))
        .when(~meets_level(verdict["level"], least), out(False, F.concat(F.lit("level "), verdict["level"], F.lit(f" is below this library's minimum of {least}"))))
        .otherwise(out(True, F.concat(F.lit("level "), verdict["level"])))
    )


def rubric() -> str:
    """The levels in words, for a judge of what no metric settles."""
    rates = ", ".join(f"{level} at {rate:.0f}" for level, rate in VELOCITY)
    return f"Levels from best: A*, A, B, C, unranked. A ranked venue decides; else citations a year do ({rates}); works of up to {GRACE} years without either are unranked."
