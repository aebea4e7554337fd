"""Resolvers of last resort as table functions: registered under a name, called in SQL by a lateral join.

``SELECT w.work, r.url, r.label FROM works w, LATERAL my_resolver(w.doi) r`` gives a candidate for every place where a
resolver may have a work's full text. Nothing is registered by default. A resolver is asked by DOI only; a work without one
has no candidate. A resolver that fails on a row gives none for it and says so in ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType


def register_resolver(spark: SparkSession, name: str, resolve: Callable[[str], Iterable[str]], label: str | None = None) -> None:
    """Registers ``resolve`` (a DOI to URLs) as the table function ``name`` with the columns place, url, label, error."""
    said = label or name

    class Resolver:
        @staticmethod
        def analyze(doi):
            from pyspark.sql.udtf import AnalyzeResult

            if doi.isConstantExpression and doi.value is None:
                raise ValueError("a resolver is asked by DOI")
            if not isinstance(doi.dataType, StringType):
                raise ValueError(f"a DOI is a string, not {doi.dataType.simpleString()}")
            return AnalyzeResult(StructType().add("place", IntegerType()).add("url", StringType()).add("label", StringType()).add("error", StringType()))

        def eval(self, doi):
            if not (doi or "").strip():
                return
            try:
                for place, url in enumerate(u for u in resolve(doi.strip()) if u):
                    yield place, url, said, None
            except Exception as e:  # one work never sinks the others
                yield None, None, said, f"{type(e).__name__}: {e}"

    spark.udtf.register(name, udtf(Resolver))


def template(pattern: str) -> Callable[[str], Iterable[str]]:
    """A resolver that is a URL with ``{doi}`` in it; only web addresses count."""
    if not pattern.startswith(("http://", "https://")) or "{doi}" not in pattern:
        raise ValueError("a template is a web address with {doi}")
    return lambda doi: [pattern.replace("{doi}", doi)]
