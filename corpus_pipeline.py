"""The training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Stages write their result to the shared folder and the next one reads it, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, minmax_dedup, mixing, quality_rules, token_output
from quire.llm.common import staged, table
from quire.llm.queries import tokenizer_path


#: Pieces that a token worker remembers; fewer than by default, as executors still hold what earlier stages left.
CACHE_PIECES = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    rows = quality_rules.cleaned_documents(docs)
    return rows.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return minmax_dedup.deduplicated(docs, length=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; a row for each document in them."""
    return token_output.token_output(docs, tokenizer_path(), cache_pieces=CACHE_PIECES)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mix", mix_sources),
    ("token output", token_ids),
]

#: SQL cannot express the line rules, min-max hashing or the tokenizer; the tests hold run()
#: against a plain version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = staged(stage(spark, rows, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
