"""The segmented index against a plain one that is built anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import segments
from quire.operators.search import Index
from quire.operators.segments import SegmentedIndex
from quire.sources.manifests import ManifestConflict

VOCABULARY = [f"w{i}" for i in range(60)]
WEIGHTS = {"title": 3.0, "body": 1.0}


def text(r: random.Random, n: int) -> str:
    return " ".join(r.choices(VOCABULARY, [1 / (i + 1) for i in range(60)], k=n))


def frame(spark, docs: dict):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "key long, title string, body string").repartition(3)


def plain(spark, docs: dict, terms, k=10**6):
    hits = Index.build(frame(spark, docs), WEIGHTS).scores(terms)
    return [(r["key"], round(r["score"], 9)) for r in hits.orderBy(F.round("score", 9), "key").limit(k).collect()]


def found(index, terms, k=10**6, allowed=None):
    return sorted(((r["key"], round(r["score"], 9)) for r in index.top(terms, k, allowed).collect()), key=lambda x: (x[1], x[0]))


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    r, docs = random.Random(4), {}
    index = SegmentedIndex(spark, str(tmp_path), WEIGHTS, block_docs=16, fanout=3)
    assert found(index, ["w1"]) == []
    for batch in range(4):
        changed = {k: (text(r, 3), text(r, r.randint(0, 40))) for k in {r.randrange(120) for _ in range(50)}}
        gone = {r.randrange(130) for _ in range(12)} - set(changed)
        m = index.apply(frame(spark, changed), spark.createDataFrame([(k,) for k in gone], "key long"))
        # Only the batch's documents are made into terms.
        assert m.segments[-1].docs == len(changed)
        docs = {k: v for k, v in (docs | changed).items() if k not in gone}
        while index.compact():
            pass
        m = index.manifest()
        assert m.docs == len(docs) and m.tokens == sum(len(f.split()) for v in docs.values() for f in v)
        assert len(m.segments) < 4
        want = plain(spark, docs, ["w2", "w50", "nothing"])
        assert found(index, ["w2", "w50", "nothing"]) == want
        assert found(index, ["w2", "w50", "nothing"], 7) == want[:7]
    before = found(index, ["w5"])
    assert index.vacuum() > 0 and found(index, ["w5"]) == before
    assert sorted((r["key"], r["n"]) for r in index.documents().select("key", "n").collect()) == sorted((k, sum(len(f.split()) for f in v)) for k, v in docs.items())


@pytest.mark.parametrize("rows,shard_docs", [(0, 50), (segments.BROADCAST_ROWS, segments.SHARD_DOCS)])
def test_only_allowed_documents_set_the_threshold(spark, tmp_path, monkeypatch, rows, shard_docs):
    monkeypatch.setattr(segments, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(segments, "SHARD_DOCS", shard_docs)
    r = random.Random(8)
    docs = {k: (text(r, 2), text(r, 20)) for k in range(300)}
    index = SegmentedIndex(spark, str(tmp_path), WEIGHTS, block_docs=8)
    index.apply(frame(spark, docs))
    index.apply(frame(spark, {5: ("w0", "w0 w1")}), spark.createDataFrame([(k,) for k in range(100, 140)], "key long"))
    docs = {k: v for k, v in docs.items() if not 100 <= k < 140} | {5: ("w0", "w0 w1")}
    allowed = [k for k in docs if k % 17 == 0]
    want = [x for x in plain(spark, docs, ["w0", "w20"]) if x[0] in set(allowed)]
    assert found(index, ["w0", "w20"], 5, spark.createDataFrame([(k,) for k in allowed], "key long")) == want[:5]
    assert found(index, ["w20"], 10**6) == plain(spark, docs, ["w20"])


def test_blocks_that_cannot_count_are_passed_over(spark, tmp_path):
    r = random.Random(2)
    docs = {k: ("", text(r, 10 + k % 300)) for k in range(1500)}
    index = SegmentedIndex(spark, str(tmp_path), WEIGHTS, block_docs=20)
    index.apply(frame(spark, docs))
    row = index.pruning(["w40", "w59"], 5).first()
    assert 0 < row["kept_blocks"] < row["blocks"] / 2 and row["kept_postings"] < row["postings"]
    assert found(index, ["w40", "w59"], 5) == plain(spark, docs, ["w40", "w59"], 5)


def test_phrases_and_payload(spark, tmp_path):
    docs = {1: ("one two", "three four"), 2: ("two one", "four three"), 3: ("two", "one two three")}
    index = SegmentedIndex(spark, str(tmp_path), WEIGHTS, positions=True, payload=("more",))
    index.apply(frame(spark, docs).withColumn("more", F.concat("title", F.lit("!"))))
    index.apply(frame(spark, {2: ("one two three", "")}).withColumn("more", F.lit("?")))
    hits = index.as_index().scores(["four"], [["one", "two"]], list(WEIGHTS.values()))
    assert {r["key"] for r in hits.collect()} == {1, 2, 3}
    assert {r["key"]: r["more"] for r in index.documents().collect()} == {1: "one two!", 2: "?", 3: "two!"}


def test_a_second_writer_is_refused_and_a_lost_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    index, other = (SegmentedIndex(spark, str(tmp_path), WEIGHTS) for _ in range(2))
    index.apply(frame(spark, {1: ("a", "b"), 2: ("", "")}))
    old = other.manifest()
    index.apply(frame(spark, {1: ("c", "d")}))
    monkeypatch.setattr(other, "manifest", lambda: old)
    with pytest.raises(ManifestConflict):
        other.apply(frame(spark, {9: ("x", "y")}))
    assert found(index, ["x"]) == [] and [k for k, _ in found(index, ["c"])] == [1] and found(index, ["a"]) == []
    assert index.vacuum() > 0 and index.manifest().docs == 2
    index.apply(frame(spark, {}), spark.createDataFrame([(1,), (2,), (3,)], "key long"))
    assert index.manifest().segments == () and found(index, ["c"]) == []
