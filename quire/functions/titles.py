"""Title similarity: the F1 of distinct lower-case ASCII tokens, 1 where the slugs agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.identifiers import slug


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def token_f1(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two distinct token arrays."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def title_similarity(a: Column, b: Column) -> Column:
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    same = (slug(a, 200) == slug(b, 200)) & (slug(a, 200) != "")
    return F.when(blank, 0.0).when(same, 1.0).otherwise(token_f1(title_tokens(a), title_tokens(b)))
