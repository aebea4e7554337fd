"""Places where the code once did less than the whole job: near copies, benchmark texts and shards on small tables."""

from __future__ import annotations

import collections
import hashlib

from pyspark.sql import functions as F

from quire.llm import decontaminate, kd_shards, minmax_dedup


def near(words, i):
    return " ".join([*words[:i], f"changed{i}", *words[i + 1 :]])


def test_near_copies_with_null_or_shared_ids_leave_one(spark):
    a, b, c = ([f"{p}{i}" for i in range(150)] for p in "abc")
    rows = [(None, " ".join(a)), (None, near(a, 40)), (None, near(a, 90)), (7, " ".join(b)), (7, near(b, 20)), (9, near(b, 70)), (None, near(b, 100)), (7, " ".join(b).upper()), (None, " ".join(c)), (11, near(c, 50)), (None, "alone"), (None, None), (12, "by itself")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter((i, (t or "-")[0].lower()) for i, t in minmax_dedup.deduplicated(df).collect())
    assert kept == {(None, "a"): 2, (7, "b"): 1, (11, "c"): 1, (None, "-"): 1, (12, "b"): 1}
    report = minmax_dedup.near_duplicates(df, length=2).collect()
    assert len(report) == len(rows) and sum(r["kept"] for r in report) == 6
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    groups = [[t for _, t in rows[:3]], [t for i, t in rows[3:8] if i == 7], [rows[9][1]]]
    assert {min(map(digest, g)) for g in groups} == {r["digest"] for r in report if r["kept"] and r["n_shingles"] > 1 and r["doc_id"] != 12}
    assert {r["component_id"] for r in report if r["digest"] in map(digest, groups[0])} == {None}


def test_every_benchmark_text_is_tiled(spark):
    x, y, z = (" ".join(f"{p}{i}" for i in range(20)) for p in "xyz")
    bench = spark.createDataFrame([(1, x), (1, y), (1, y), (None, z), (2, x)], "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + x), (2, "so " + y), (3, "so " + z), (4, x + " " + z), (5, "nothing of it"), (None, y)], "doc_id long, text string")
    found = collections.Counter((r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.leaks(df, bench).collect())
    assert found == {(1, 1, 1.0): 1, (1, 2, 1.0): 1, (2, 1, 1.0): 1, (3, None, 1.0): 1, (4, 1, 1.0): 1, (4, 2, 1.0): 1, (4, None, 1.0): 1, (None, 1, 1.0): 1}
    assert [r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()] == [5]


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (None, None), (3, "one"), (3, "one"), (3, "two"), (4, "four"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    placed = kd_shards.kd_shards(df, ["n_chars"], shards=2)
    written = spark.read.parquet(kd_shards.write_sharded(df, placed, str(tmp_path / "shards"))).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in written) == collections.Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in written) == sorted((r["shard"], r["slot"]) for r in placed.collect())
