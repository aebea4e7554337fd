"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import conversation_repair, decontaminate, html_text, kd_shards, language_id, minmax_dedup, mixing, quality_rules, radix_dedup, token_output, url_filter, vector_codes, warc
from quire.llm.common import table

#: (verdict, host, path) of the URL filter's production rules.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed token ids, read back from the files."""
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds most of a benchmark item, with the item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "tiles", "tile_words", "longest")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = kd_shards.kd_shards(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lookup of every page's URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken by the mix of all sources."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), length=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the archives."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the test damage."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(turns), turns)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, 16 parts of 64 entries."""
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return radix_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_output": op2_token_output,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

URL_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(verdict, h, pre)),
m AS (SELECT p.*, r.verdict, h || pre AS rule, row_number() OVER (PARTITION BY n ORDER BY length(h || pre) DESC NULLS LAST, r.verdict DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < {warc.MIN_REVISIT_BYTES} OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to FROM m
"""


def _quality_sql(rules: quality_rules.LineRules = quality_rules.DEFAULT) -> str:
    """Line rules and statistics in SQL; lines and windows become rows."""
    word, ends = "[^ \\t\\n\\x0B\\f\\r]+", "[ \\t\\n\\x0B\\f\\r]"
    quoted = lambda x: x.replace("'", "''").replace("(?iu)", "(?i)")
    marks = "".join("\\" + c if c in "#*$&|" else c for c in quality_rules.SYMBOLS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM g),
q AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS c FROM q GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
f AS (SELECT doc_id, x, len(regexp_extract_all(x, '{word}')) AS n, length(x) - length(regexp_replace(x, '[{marks}]+', '', 'g')) AS sym, length(x) - length(regexp_replace(x, '[{rules.separators}]+', '', 'g')) AS sep,
  len(regexp_extract_all(x, '[!?]{{2,}}')) AS loud, regexp_matches(x, '[a-z]|\\p{{Ll}}|\\p{{Lo}}') AS low, length(x) <= {rules.boilerplate_line_chars} AS short FROM l),
b AS (SELECT doc_id, x, n, CASE WHEN n = 0 THEN false WHEN sep >= 2 AND sep > n * {rules.max_separator_share} OR sym > n * {rules.max_symbols_per_word} OR loud > n * {rules.max_shout_share} OR NOT low AND n >= {rules.caps_line_words} THEN true
  WHEN short AND (regexp_matches(x, '{quoted(rules.navigation)}') OR regexp_matches(x, '{quoted(rules.boilerplate)}')) THEN true ELSE NOT regexp_matches(x, '[{quoted(rules.terminal)}][{quoted(rules.closing)}]*({ends}|$)') END AS bad FROM f),
a AS (SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(n) FILTER (bad), 0) AS lost FROM b GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[{marks}]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(a.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.c, 0) AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad AS BIGINT) AS n_bad_lines, CAST(lost AS BIGINT) AS lost_words FROM d JOIN a USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND lost_words <= {rules.max_lost_share} * n_words AS kept FROM s
"""


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _edited(state: str, letter: str, cost: str, line: str | None = None) -> str:
    """A path (cost, audit, text) with another edit."""
    text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}"


def _repair_sql() -> str:
    """The cheapest path to each state of the grammar, row by row; nothing is determinised."""
    far = "{'c': CAST(1000000 AS BIGINT), 'a': '', 't': ''}"
    own, more = "role || ':' || text", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    keep = lambda s, initial: f"CASE WHEN fault IN ('sound', 'truncated') AND left(role, 1) = '{initial}' THEN {_edited(s, 'K', more, own)} ELSE {far} END"
    role = lambda s, name: f"CASE WHEN fault IN ('sound', 'truncated') THEN {_edited(s, 'R', '3 + ' + more, repr(name + ':') + ' || text')} ELSE {far} END"
    insert = lambda s, name: _edited(s, "I", "3", repr(name + ":"))
    drop = lambda s: _edited(s, "D", "4")
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 20 AS fate FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fate <> 0),
m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), copy) AS n FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*$') THEN 'truncated' ELSE 'sound' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM m),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {far} AS s1, {{'c': CAST(3 AS BIGINT), 'a': 'I', 't': 'user:'}} AS s2, {{'c': CAST(6 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, s0, s1, s2, {_least('s3', insert('s2', 'assistant'))} FROM (
    SELECT conv_id, n, s0, s1, {_least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS s2, s3 FROM (
      SELECT w.conv_id, r.n, {drop('s0')} AS s0, {_least(drop('s1'), keep('s0', 's'))} AS s1,
        {_least(drop('s2'), *[x for s in ('s0', 's1', 's3') for x in (keep(s, 'u'), role(s, 'user'))])} AS s2, {_least(drop('s3'), keep('s2', 'a'), role('s2', 'assistant'))} AS s3
      FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))),
z AS (SELECT conv_id, arg_max({_least('s0', 's3')}, n) AS best FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256 FROM z LEFT JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64) -> str:
    """Distances of every part to every entry; for vectors of parts * width components."""
    far = " + ".join(f"(x{d} - y{d}) * (x{d} - y{d})" for d in range(width))
    ys, xs = ", ".join(f"y{d}" for d in range(width)), ", ".join(f"x{d}" for d in range(width))
    new = ", ".join(f"coalesce(CAST(floor(m{d} / n) AS BIGINT), y{d}) AS y{d}" for d in range(width))
    sums = ", ".join(f"CAST(sum(x{d}) AS DOUBLE) AS m{d}" for d in range(width))
    steps = []
    for i in range(3):
        steps.append(f"a{i} AS (SELECT vec_id, p, {xs}, min(({far}) * 256 + b{i}.e) AS key FROM pt JOIN b{i} USING (p) GROUP BY ALL)")
        if i < 2:
            steps.append(f"b{i + 1} AS (SELECT p, e, {new} FROM b{i} LEFT JOIN (SELECT p, key % 256 AS e, count(*) AS n, {sums} FROM a{i} GROUP BY 1, 2) USING (p, e))")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS (SELECT vec_id, e, p, {', '.join(f'v[p * {width} + {d + 1}] AS x{d}' for d in range(width))} FROM k, range({parts}) t(p)),
b0 AS (SELECT p, e, {', '.join(f'x{d} AS y{d}' for d in range(width))} FROM pt WHERE e < {entries}),
{', '.join(steps)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', key % 256), '' ORDER BY p) AS code, CAST(sum(key // 256) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(concat_ws(',', {ys}), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DUPLICATES_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256 FROM t WINDOW w AS (PARTITION BY body)
"""


#: Of the others SQL cannot express the method; the tests hold them against brute force and round trips.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality_sql(),
    "op5_url_filters": URL_SQL,
    "op6_mixing": mixing.ORACLE,
    "op9_warc": WARC_SQL,
    "op11_conversation_repair": _repair_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_exact_dedup": DUPLICATES_SQL,
}
