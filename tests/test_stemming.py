"""Porter's stems and folded search against SQLite's full-text tokenizer; character references against Python's."""

from __future__ import annotations

import html
import html.entities
import itertools
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions.stemming import porter
from quire.functions.venues import unescaped
from quire.plans.queries import QUERIES, WORD_FORMS

BASES = "run hop fall hiss fail file relate condition rational valenc hesitanc digit conform radical differ vile analog vietnam predic operat feudal decisive hopeful callous formal sensitiv sensibl triplic form electr good goodn reviv allow infer air gyroscop adjust defens irrit replac depend adopt homolog communi activ effectiv bowdler probat rate cease control roll agree plaster motor tann siz happ sk by say cr ab y eye die theor".split()
ENDS = "s es ies sses ed ing eed edly ly y ational tional enci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion sion tion ou ism ate iti ous ive ize e ee ll logi ational".split()


def sqlite_terms(words):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words)))
    return dict(con.execute("select doc, term from v"))


def test_stems_equal_those_of_sqlite():
    words = sorted({b + e for b, e in itertools.product(BASES, ["", *ENDS])} | {"generalizations", "oscillators", "troubling", "skies", "dying", "feed", "bled", "sing"})
    terms = sqlite_terms(words)
    assert [(w, porter(w)) for i, w in enumerate(words) if terms[i] != porter(w)] == []


def test_word_forms_are_found_as_sqlite_finds_them(spark, tmp_path):
    texts = ["Ering things", "THE THING. Thé", "there, theres", "oùs and Ou", "nothing here", "", None, "eréd; ered", "théres"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"] for r in QUERIES["search_word_forms"](spark, str(tmp_path)).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", [(i, t or "") for i, t in enumerate(texts)])
    want = {r[0] for r in con.execute("select rowid from t where t match ?", [" OR ".join(f'"{w}"' for w in WORD_FORMS)])}
    assert got == want and len(want) > 4


def test_every_character_reference_is_decoded(spark):
    raw = [f"x&{n}y&{n}" for n in html.entities.html5 if n.endswith(";")]
    raw += [f"&#{n};" for n in [0, 1, 9, 10, 13, 31, 32, 65, 127, 128, 129, 150, 159, 160, 255, 256, 0x2014, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]]
    raw += ["&#x2014;", "&#X1f600; a", "&#x00000041;", "&#0000065;", "a & b; c", "&;", "&nosuchname;", "&amp;lt;", "no reference", "", "&#xFFFFFFFFFFFF;"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    got = {r["i"]: r["t"] for r in df.select("i", unescaped(F.col("t")).alias("t")).collect()}
    assert [(t, got[i], html.unescape(t)) for i, t in enumerate(raw) if got[i] != html.unescape(t)] == []


def test_references_query_against_sql(spark, tmp_path):
    from quire.plans.queries import ORACLES

    spark.range(1, 300).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["html_references"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["html_references"]).fetchall())
