"""Places where the code once did less than the whole job: brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from quire.operators import search as searching
from quire.plans.queries import QUERIES


def test_find_duplicate_reads_every_language_and_whole_titles(spark, tmp_path):
    long = "Wörter " * 100
    rows = [
        (1, "Über alles", "de"), (2, "uber - ALLES", None), (4, long + "a", "fr"), (5, long + "b", "en"), (6, ". " * 900 + "late words", "en"), (7, "late words", "es"),
        (8, "x" * 200 + "one", "en"), (10, "x" * 200 + "one", "en"), (12, "q" * 201 + " same end " * 25, None), (15, "r" * 201 + " same end " * 25, "de"), (16, "!?", "en"), (18, "...", None), (20, "!?", "de"), (21, None, "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def identities(i, t):
        if t is None:
            return set()
        s = re.sub("[^a-z0-9]", "", t.lower().replace("ö", "o").replace("ü", "u"))[:200]
        return {("title", s)} - {("title", "")} | ({("doi", hashlib.md5(t.encode()).hexdigest())} if i % 2 == 0 else set()) | ({("arxiv", t[-200:])} if i % 3 == 0 else set())

    ids = {i: identities(i, t) for i, t, _ in rows}
    want = {i: min(j for j in ids if ids[i] & ids[j]) for i in ids if ids[i]}
    assert want[2] == 1 and want[7] == 6 and want[15] == 12 and want[20] == 16
    assert dict(map(tuple, QUERIES["find_duplicate"](spark, str(tmp_path)).collect())) == want


def test_search_folds_accents_and_stems(spark, tmp_path):
    titles = [("k1", "Théorie des jeux", ["Jörg Müller"]), ("k2", "They run and running helps", []), ("k3", "Nguye\u0302\u0303n walked", ["Nguyễn"]), ("k4", "Теория игр", []), ("k5", "other", [])]
    rows = [(k, t, a, None, None, [], [], [], None) for k, t, a in titles]
    df = spark.createDataFrame(rows, "key string, title string, authors array<string>, one_liner string, abstract string, tags array<string>, sections array<struct<name: string, summary: string>>, key_findings array<string>, notes string")
    found = lambda q, **o: sorted(r["key"] for r in searching.search(df, q, **o).collect())
    assert found("theorie") == found("THÉORIE") == found("the\u0301orie") == ["k1"] and found("muller") == ["k1"]
    assert found('"jorg müller"') == ["k1"] and found("nguyen") == found("Nguyễn") == ["k3"] and found("теория") == ["k4"] and found("orie") == []
    assert found("runs", stem=False) == [] and found("runs") == ["k2"] and found("walking") == ["k3"] and found('"walks"') == ["k3"]
    index = searching.Index.build(searching.entry_fields(df), searching.FIELD_WEIGHTS, positions=True, fold=True, stem=True)
    index.save(f"{tmp_path}/index")
    loaded = searching.Index.load(spark, f"{tmp_path}/index")
    assert (loaded.fold, loaded.stem) == (True, True) and found("théorie runs", index=loaded) == ["k1", "k2"]
    plain = searching.Index.build(searching.entry_fields(df), searching.FIELD_WEIGHTS)
    assert found("running", index=plain) == ["k2"]
    with pytest.raises(ValueError):
        found("runs", index=plain, stem=True)
