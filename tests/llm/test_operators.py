"""The training-data operators against brute force, exact round trips and the edge cases that they define."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, html_text, kd_shards, language_id, minmax_dedup, mixing, quality_rules, token_output, url_filter, warc
from quire.llm.queries import QUERIES, URL_RULES, tokenizer_path

random.seed(11)
VOCABULARY = [a + b for a in ("th", "re", "ing", "on", "er", "ti", "sh") for b in ("a", "en", "or", "ly", "ou", "e")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


def corpus_rows() -> list[tuple]:
    texts = [prose(random.randint(25, 120)) for _ in range(60)]
    for i in range(0, 20, 2):  # near and exact copies
        words = texts[i].split()
        words[3] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i])
    texts += ["the same line of words goes here again.\n" * 12, "ALL CAPS!! SHOUTED!! WORDS!! " * 10, "a | b | c | d | e | f " * 8, "w*** x### y$$$ " * 20, "", None, "short.", prose(3000)]
    texts.append("\n".join([prose(30), "Home", "All rights reserved.", prose(30)]))
    return [(i, t, ("en", "de", None)[i % 3], (None, "s1", "s2", "s0")[i % 4], len(t or "")) for i, t in enumerate(texts)]


ROWS = corpus_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeats and clashing columns."""
    rows = [(1, None, None), (2, "", "en"), (3, "one two", "en"), (3, "one two", "en"), (None, "ONE two", None), (None, None, None), (7, "a b c", "de"), (7, "d e f", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "size": F.lit("x"), "kept": F.lit("y"), "shard": F.lit(5), "digest": F.lit("z")})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_statistics(docs):
    def brute(t):
        w = words(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    text = {r[0]: r[1] for r in ROWS}
    for r in quality_rules.quality_report(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(text[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (r["kept"] and r["base_failed"])


def test_quality_lines(docs, odd):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    last = max(rows)
    assert rows[last]["kept"] and rows[last]["faults"] == ["navigation", "boilerplate"] and "Home" not in rows[last]["clean_text"]
    assert all(rows[i]["kept"] for i in range(60)) and not any(rows[i]["kept"] for i in rows if i >= 80 and i not in (last, last - 1))
    out = quality_rules.quality_rules(odd)
    assert out.count() == 8 and dict(out.dtypes)["kept"] == "boolean" and quality_rules.quality_report(odd.limit(0)).count() == 0


def test_token_round_trip(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    start, want = 0, {}
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    out = f"file://{tmp_path}/tokens"
    manifest, dictionary = token_output.write_shards(docs, tokenizer_path(), out)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_shards(manifest, out, dictionary).collect()} == want
    shard = manifest.orderBy("shard").first()
    assert zlib.crc32(token_output.read_document(out, shard["file"], 0, dictionary).tobytes()) == want[0][2]
    with pytest.raises(ValueError):
        token_output.read_document(out, shard["file"], 0, b"another dictionary")
    assert token_output.token_output(odd, tokenizer_path()).count() == 8 and token_output.token_output(odd.limit(0), tokenizer_path()).count() == 0


def test_pieces_join_to_whole_encodings():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_output.PieceEncoder(tokenizer_path(), cache_pieces=50)
    texts = ["", " ", "a\n\nb", "a  b", " a", "a \tb", "a\n b", "don't 's <|endoftext|>. x", "é. b, c", "a\x1c b", "ab.\ncd,"]
    texts += ["".join(random.choice(["ab", " ab", "\nab", ".", ",", " ", "1", "é", "'s"]) for _ in range(30)) for _ in range(500)]
    for t, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tiles_against_the_plain_algorithm():
    def plain(doc, item, least):
        least, a, b, total = min(least, len(item)), [False] * len(doc), [False] * len(item), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(doc)):
                for k in range(len(item)):
                    n = 0
                    while i + n < len(doc) and k + n < len(item) and doc[i + n] == item[k + n] and not a[i + n] and not b[k + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, k)
            if best[0] < least:
                return total
            for x in range(best[0]):
                a[best[1] + x] = b[best[2] + x] = True
            total += best[0]

    for _ in range(150):
        item, doc = [random.choice("abc") for _ in range(random.randint(1, 20))], [random.choice("abc") for _ in range(random.randint(0, 30))]
        least = random.choice([3, 4, 6])
        assert sum(t[2] for t in decontaminate.tiles(doc, item, least)) == plain(doc, item, least)


def test_decontamination(spark, odd):
    item = prose(40)
    w = item.split()
    moved = " ".join([prose(30), *w[20:], prose(10), *w[:20], prose(20)])
    rows = [(1, prose(80)), (2, prose(20) + " " + item.upper() + " " + prose(9)), (3, moved), (3, moved), (None, moved), (5, " ".join(w[:9]) + " " + prose(50)), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "Two words!")], "item_id long, text string")
    found = sorted((r["doc_id"] or -1, r["item_id"], r["tiles"]) for r in decontaminate.leaks(df, bench).collect())
    assert found == [(-1, 9, 2), (2, 9, 1), (3, 9, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()) == [1, 5, 6]
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.decontaminated(df.limit(0), bench).count() == 0


def test_kd_shards(docs, odd):
    rows = kd_shards.kd_shards(docs, ["source", "lang", "n_chars"], shards=4).collect()
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert len(rows) == len(ROWS) and all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(4))
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    largest = max(map(len, text.values())) + 1
    assert max(sizes.values()) - min(sizes.values()) <= largest
    assert kd_shards.kd_shards(odd, ["source", "n_chars"], shards=3).count() == 8 and kd_shards.kd_shards(odd.limit(0), ["n_chars"], shards=3).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://A.ORG", "https://a.org/", "http://x.example.org/es/1", "http://example.org/en/17?q", "http://example.org/fr", "http://b.com/fr/", "http://b.com/de/x#y", "http://org.net/", "http://u@h.org:80/a://b"]
    urls += urls[4:8]

    def brute(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow"

    pages = spark.createDataFrame([(i % 13, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = collections.Counter(map(tuple, url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect()))
    assert got == collections.Counter((i % 13, *brute(u)) for i, u in enumerate(urls))
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES).limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_mixing(spark, docs, odd, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    rows = sorted(map(tuple, mixing.mix_report(spark.read.parquet(str(tmp_path / "d"))).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert rows == sorted(con.execute(mixing.ORACLE).fetchall())
    assert all(r[4] <= 2 * r[1] for r in rows) and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(odd).count() == 8 and mixing.mix_report(odd.limit(0)).count() == 0


def test_near_duplicates(docs, odd, spark):
    def brute(length):
        sets = [frozenset(tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))) if (w := (t or "").encode().lower().split()) else frozenset() for _, t, *_ in ROWS]
        part = list(range(len(sets)))
        find = lambda x: x if part[x] == x else find(part[x])
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[max(find(a), find(b))] = min(find(a), find(b))
        return {i: (len(sets[i]), find(i)) for i in range(len(sets))}

    for length in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax_dedup.near_duplicates(docs, length=length).collect()}
        assert got == brute(length)
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(odd, length=2).collect()}
    assert rows[3, 1] == (3, True) and rows[None, 1] == (3, False) and rows[1, 0] == (1, True) and rows[None, 0] == (None, True)
    assert minmax_dedup.deduplicated(odd).count() == 6 and minmax_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    """A chain of texts, each close to its neighbours only, is one component without all pairs being compared."""
    base = prose(60).split()
    texts = []
    for i in range(120):
        base[(i * 7) % 60] = f"w{i}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minmax_dedup.near_duplicates(df, length=2).collect()} == {0}


def test_language_id(spark, odd):
    letters = {"xx": "abcdefgh", "yy": "mnopqrst"}
    rows = [(i, " ".join("".join(random.choice(letters[g]) for _ in range(5)) for _ in range(30)), g) for i in range(200) for g in (("xx", "yy")[i % 2],)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    held = [i for i in out if out[i]["held_out"]]
    assert held and sum(out[i]["lang_pred"] == rows[i][2] for i in held) / len(held) >= 0.95 and all(0 <= r["score"] <= 1 for r in out.values())
    got = language_id.identify(odd).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2)} == {"und"} and language_id.identify(odd.limit(0)).count() == 0
    hidden = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in hidden] == ["und"]


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "x" * 50 if i % 3 else "y" * 1500) for i in range(30)] + [(None, None, None), (27, "http://h/27", "y" * 1500), (31, "bad url\r\n", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = warc.warc_round_trip(pages, roll_bytes=2000).collect()
    assert len(out) == len(rows)
    for r in out:
        html = (next(h for i, _, h in rows if i == r["page_id"]) or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
    big = [r for r in out if r["payload_bytes"] == 1500]
    assert sum(r["record_type"] == "response" for r in big) == 1 and {r["refers_to"] for r in big if r["record_type"] == "revisit"} == {27}
    assert all(r["record_type"] == "response" for r in out if r["payload_bytes"] != 1500) and warc.warc_round_trip(pages.limit(0)).count() == 0


def test_html(spark):
    text = html_text.main_text
    assert text("<body><div class='menu'>m</div><main><h1>A &amp; B</h1><p>x<br>y <i>z</i>w<p>q<ul><li>1<li>2</ul><aside>no</aside><!-- c --><div id=comments>no</div> tail &nbsp; 5 < 6 </main>") == "A & B\n\nx y zw\n\nq\n\n1\n\n2\n\ntail 5 < 6"
    assert text("a<script>x</b>") == "a" and text(None) == "" and text("<p>x<!-- open") == "x"
    menu = "<div><a href='/a'>Alpha</a> <a href='/b'>Beta</a></div>"
    rows = [(i, f"http://h.org/{i}", f"<body>{menu}<div><p>{prose(12)}</p></div><div>the end of all</div>") for i in range(8)]
    rows += [(100 + i, f"http://g.org/{i}", f"<article><p>Shared sentence.</p><p>{prose(9)}</p></article>") for i in range(8)] + [(200, None, None), (200, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Alpha" not in got[i] and "the end" not in got[i] and got[i] for i in range(8))
    assert all(got[100 + i].startswith("Shared sentence.\n\n") for i in range(8)) and got[200] == ""


def test_queries_and_pipeline(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["quality rules", "near dedup", "decontamination", "source mix", "token output"] and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    single = corpus_pipeline.near_dedup(spark, kept, folder)
    assert single.count() < kept.count() and single.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, single, folder)
    assert clean.columns == docs.columns
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in clean.collect()}
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
