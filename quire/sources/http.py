"""Fetching over HTTP from the executors: a host's requests in order and spaced, retries with growing pauses.

What a fetch says is kept apart: ``ok``, ``absent`` (the host answered that there is nothing) and ``unavailable`` (no
answer was had), since the last says nothing about the work.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shipping import map_batches

# Retries, pauses and the spacing that hosts ask for.
TRIES, FIRST_PAUSE, LONGEST_PAUSE, TIMEOUT = 3, 1.0, 30.0, 60.0
SPACING = {"export.arxiv.org": 3.0, "arxiv.org": 1.0, "api.semanticscholar.org": 1.2}
BATCH = 500
OUTCOME = "url string, status int, outcome string, body binary"


def plain_get(url: str) -> tuple[int, bytes, dict]:
    """(status, body, headers); OSError if the host cannot be reached."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, b"", dict(e.headers or {})


def fetched(url: str, get: Callable[[str], tuple[int, bytes, dict]], sleep: Callable[[float], None] = time.sleep) -> dict:
    """One URL with retries: a 429 or 5xx is tried again after what the host asks for, at most half a minute."""
    pause, status = FIRST_PAUSE, None
    for attempt in range(TRIES):
        try:
            status, body, headers = get(url)
        except OSError:
            status, body, headers = None, b"", {}
        if status is not None and status < 400:
            return {"url": url, "status": status, "outcome": "ok", "body": body}
        if status is not None and status != 429 and status < 500:
            return {"url": url, "status": status, "outcome": "absent", "body": None}
        if attempt + 1 < TRIES:
            asked = str(headers.get("Retry-After", ""))
            sleep(min(LONGEST_PAUSE, float(asked) if asked.isdigit() else pause))
            pause *= 2
    return {"url": url, "status": status, "outcome": "unavailable", "body": None}


def fetch(requests: DataFrame, get: Callable[[str], tuple[int, bytes, dict]] = plain_get, spacing: dict[str, float] | None = None) -> DataFrame:
    """url, status, outcome and body of every distinct URL; one task has a host's requests, so its spacing holds."""
    spaces = SPACING if spacing is None else spacing
    rows = requests.select("url").where("coalesce(url, '') <> ''").distinct().withColumn("host", F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)))
    rows = rows.repartition("host").sortWithinPartitions("host", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        types = pa.schema([("url", pa.string()), ("status", pa.int32()), ("outcome", pa.string()), ("body", pa.binary())])
        for b in batches:
            for url, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wait = last.get(host, 0.0) + spaces.get(host, 0.0) - time.monotonic()
                if host in last and wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                yield pa.RecordBatch.from_pylist([fetched(url, get)], types)

    return map_batches(rows, run, OUTCOME)


def unavailable(outcomes: DataFrame) -> DataFrame:
    """outcome, n: absent and unavailable told apart."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def lookups(works: DataFrame) -> DataFrame:
    """work, source, url: what to ask the indexes about works with doi, arxiv_id or title."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    ident = F.coalesce(F.concat(F.lit("DOI:"), some("doi")), F.concat(F.lit("ARXIV:"), some("arxiv_id")))
    made = lambda source, url: F.struct(F.lit(source).alias("source"), url.alias("url"))
    options = F.array(
        made("crossref", F.concat(F.lit("https://api.crossref.org/works/"), some("doi"))), made("arxiv", F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), some("arxiv_id"), F.lit("&max_results=1"))),
        made("semanticscholar", F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/"), ident)), made("title", F.when(ident.isNull(), F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/search?limit=8&query="), F.url_encode(some("title"))))),
    )
    return works.select("work", F.inline(F.filter(options, lambda o: o["url"].isNotNull())))


def batches(idents: DataFrame, size: int = BATCH) -> DataFrame:
    """batch, idents: identifiers in groups of at most ``size`` for a bulk lookup; a group stays in its partition."""
    place = F.monotonically_increasing_id()
    rows = idents.select(F.col("ident")).distinct().withColumn("_p", place).withColumn("batch", F.concat_ws("-", F.shiftright("_p", 33).cast("string"), F.floor(F.col("_p").bitwiseAND(F.lit((1 << 33) - 1)) / size).cast("string")))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "ident"))), lambda x: x["ident"]).alias("idents"))


def positional(answers: DataFrame) -> DataFrame:
    """ident, payload of batch answers (idents, payloads) whose order is that of the question; nulls are absent works."""
    return answers.select(F.inline(F.arrays_zip(F.col("idents").alias("ident"), F.col("payloads").alias("payload")))).where("payload is not null")


def sampled_text(pages: DataFrame, budget: int = 10, long_pages: int = 50) -> DataFrame:
    """doc, text, pages, pages_read of a page table (doc, page, text): long documents are sampled, gaps are marked."""
    from quire.functions.documents import chosen_pages

    totals = pages.groupBy("doc").agg((F.max("page") + 1).cast("int").alias("pages"))
    wanted = F.when(F.col("pages") > long_pages, chosen_pages(F.col("pages"), F.lit(budget))).otherwise(F.sequence(F.lit(0), F.col("pages") - 1))
    chosen = totals.select("doc", "pages", F.explode(wanted).alias("page")).join(pages, ["doc", "page"])
    joined = chosen.groupBy("doc", "pages").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))

    def marked(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("p"), i - 1)["page"]).otherwise(-1)
        return F.concat(F.when(x["page"] > before + 1, F.concat(F.lit("[... pages "), (before + 2).cast("string"), F.lit("-"), x["page"].cast("string"), F.lit(" not read ...]\n\n"))).otherwise(""), F.coalesce(x["text"], F.lit("")))

    return joined.select("doc", F.array_join(F.transform("p", marked), "\n\n").alias("text"), "pages", F.size("p").alias("pages_read"))
