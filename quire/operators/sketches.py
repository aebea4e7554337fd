"""Statistics that can be added up: a library's distinct counts and quantiles as sketches, united over libraries.

A sketch is a few kilobytes whatever it stands for, so libraries are sketched where they are and only sketches are brought
together. Distinct counts are HyperLogLog with a relative standard error of 1.04 / sqrt(2 ** LG); quantiles are KLL
sketches whose ranks are off by RANK_ERROR of all rows at most, with 99 % confidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct count, and the size of a quantile sketch.
LG, KLL_SIZE = 12, 400
DISTINCT_ERROR = 1.04 / math.sqrt(1 << LG)
RANK_ERROR = 0.0075


def sketched(rows: DataFrame, by: list[str], *, distinct: tuple[str, ...] = (), quantiles: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rows, and a sketch for each column: distinct_<column> and quantiles_<column> (of numbers as doubles)."""
    counts = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG)).alias(f"distinct_{c}") for c in distinct]
    ranks = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(f"quantiles_{c}") for c in quantiles]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *counts, *ranks)


def united(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the same columns added up, over all rows or by fewer columns."""
    counts = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("distinct_")]
    ranks = [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("quantiles_")]
    return sketches.groupBy(*(by or [])).agg(F.sum("rows").alias("rows"), *counts, *ranks)


def estimates(sketches: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketches read: counts as numbers, quantiles as arrays at the given ranks."""
    read = []
    for c in sketches.columns:
        if c.startswith("distinct_"):
            read.append(F.hll_sketch_estimate(c).alias(c))
        elif c.startswith("quantiles_"):
            read.append(F.kll_sketch_get_quantile_double(F.col(c), F.array(*[F.lit(float(x)) for x in at])).alias(c))
        else:
            read.append(F.col(c))
    return sketches.select(*read)


def near(estimate: Column, exact: Column, sigmas: float = 4.0) -> Column:
    """Whether a distinct count is within so many standard errors of the exact one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), sigmas * DISTINCT_ERROR * exact)
