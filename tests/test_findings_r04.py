"""Results that differed from their SQL on larger tables or odd rows."""

from __future__ import annotations

import random

import duckdb
import pytest
from quire.operators import segments
from quire.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name,common,rare,nulls", [("block_max_search", "the", "que", 0), ("block_max_search", "the", "que", 150), ("incremental_index", "thing", "quela", 40)])
def test_scores_that_tie_when_rounded_go_by_key(spark, tmp_path, monkeypatch, name, common, rare, nulls):
    # Ranges of some ten documents, so that most are passed over or kept by their bound.
    monkeypatch.setattr(segments, "BLOCK_TOKENS", 1000)
    rng = random.Random(7)
    texts = [" ".join(rng.sample(words := [common] * rng.randint(1, 9) + ["filler"] * rng.randint(40, 120), len(words))) for _ in range(500)]
    # Twenty differ by more than a rounded digit; the common word's least weight leaves the others two values or three.
    docs = list(enumerate([f"{rare} {t}" if i % 25 == 3 else t for i, t in enumerate(texts)] + [None] * nulls + [""] * 5))
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sql.execute(ORACLES[name]).fetchall()
    assert len(want) == 50 and len({r[1] for r in want[20:]}) < 10
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == want
