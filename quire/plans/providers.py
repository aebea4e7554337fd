"""What a model or a network would answer, behind one small interface, and table-backed stand-ins for it.

An engine run asks a provider for a table; what the provider does to fill it is its own affair. The stand-ins read
tables and are deterministic. A provider that fails never sinks a batch: the caller goes on without its answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shipping import map_batches

#: Keys that an answer of each role must have.
REQUIRED = {
    "plan": ("queries",), "scout": ("papers",), "rank": ("scores",), "filter": ("relevant",), "reader": ("one_liner", "sections"), "evidence": ("relevant",), "origin": ("is_origin",), "synthesis": (), "code": ("repo_url",), "check": ("fields",),
}


class Provider(Protocol):
    def answer(self, role: str, asked: DataFrame) -> DataFrame | None:
        """The answers to ``asked`` in the role, or null if there are none."""


class Tables:
    """Answers that are tables already, by role; each is joined to what is asked on the columns they share."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def answer(self, role: str, asked: DataFrame) -> DataFrame | None:
        table = self.tables.get(role)
        if table is None:
            return None
        shared = [c for c in asked.columns if c in table.columns]
        return asked.distinct().join(table, shared) if shared else table


def asked_each(rows: DataFrame, function: Callable[[dict], dict], schema: str, *, key: str = "key") -> DataFrame:
    """Calls ``function`` for every row on the executors: key, value, error; an error concerns its row only."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    inner = to_arrow_type(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, errors = [], []
            for row in b.to_pylist():
                try:
                    values.append(function(row))
                    errors.append(None)
                except Exception as e:  # one item never sinks the others
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(key)), pa.array(values, inner), pa.array(errors, pa.string())], [key, "value", "error"])

    return map_batches(rows, run, f"{key} {dict(rows.dtypes)[key]}, value struct<{schema}>, error string")


def usage(calls: DataFrame) -> DataFrame:
    """model, calls, cost of a log of calls."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def contract(role: str, fields: dict[str, str], **given: str) -> str:
    """The text that a model would be asked: the role, what is given and the fields that the reply must hold."""
    lines = [f"Role: {role}. Reply with one JSON object and nothing else."]
    lines += [f"{k}: {v}" for k, v in given.items() if v]
    lines += ["Fields:"] + [f"- {k}: {v}" for k, v in fields.items()]
    return "\n".join(lines)


def repair(error: str, required: tuple[str, ...]) -> str:
    """What is asked when a reply could not be read."""
    keys = ", ".join(required)
    return f"Your reply could not be used ({error}). Send the same content again as one JSON object" + (f" with the keys {keys}." if keys else ".")
