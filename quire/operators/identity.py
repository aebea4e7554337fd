"""Which records are one work: duplicates, keys, links between references and entries, title matches.

Disjunctive identities (DOI or arXiv id or title) are unions of equi-joins with a priority, never an OR in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import slug
from quire.functions.titles import title_tokens, token_f1
from quire.functions.venues import let
from quire.sources.storage import staged


def _title_slug(title: Column, size: int = 200, ahead: int = 1000) -> Column:
    """The slug of a title of any length; only where its start does not fill the slug is a long one folded whole."""
    return let(slug(F.substring(title, 1, ahead), size), lambda start: F.when((F.length(start) == size) | (F.length(title) <= ahead), start).otherwise(slug(title, size)))


def identities(doi: Column, arxiv_id: Column, title: Column) -> Column:
    """array of (kind, value) by which a work can be found."""
    pairs = [("doi", F.lower(doi)), ("arxiv", arxiv_id), ("title", _title_slug(title))]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs]), lambda x: x["value"] != "")


def find_duplicates(wanted: DataFrame, entries: DataFrame, *, wanted_id: str = "id", key: str = "key") -> DataFrame:
    """id, key: for each wanted work the first entry in key order that shares any identity with it."""
    ids = lambda d, name: d.select(F.col(name).alias("_" + name), F.explode(identities(F.col("doi"), F.col("arxiv_id"), F.col("title"))).alias("_i")).select("_" + name, F.col("_i.kind").alias("_kind"), F.col("_i.value").alias("_value"))
    # Many entries may share an identity; only the first can win, so that is all that is joined.
    first = ids(entries, key).groupBy("_kind", "_value").agg(F.min("_" + key).alias("_first"))
    return ids(wanted, wanted_id).join(first, ["_kind", "_value"]).groupBy(F.col("_" + wanted_id).alias(wanted_id)).agg(F.min("_first").alias(key))


def link_references(entries: DataFrame) -> DataFrame:
    """Entries whose references carry the key of the entry that they name, with ``linked``, how many do."""
    entries = staged(entries, "link-entries")
    refs = entries.select(F.col("key").alias("citing"), F.posexplode("references").alias("at", "r")).withColumn("id", F.struct("r.doi", "r.arxiv_id", "r.title"))
    # Works are named many times: each is looked up once.
    named = refs.select("id").distinct().select("id", "id.*")
    found = staged(find_duplicates(named, entries).withColumnRenamed("key", "_found"), "link-found")
    refs = refs.join(found, "id", "left").withColumn("_found", F.when(F.col("_found") != F.col("citing"), F.col("_found")))
    again = refs.groupBy(F.col("citing").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("r").withField("key", F.coalesce("_found", "r.key")).alias("r")))), lambda x: x["r"]).alias("references"), F.count("_found").alias("linked")
    )
    return entries.drop("references").join(again, "key", "left").withColumn("linked", F.coalesce("linked", F.lit(0).cast("long")))


def suffix(n: Column) -> Column:
    """'' for the first, a to z for the next, then 2, 3 and so on."""
    return F.when(n == 0, "").when(n <= 26, F.char(F.lit(96) + n)).otherwise((n - 25).cast("string"))


def unique_keys(wanted: DataFrame, taken: DataFrame, *, base: str = "base", order: str = "id") -> DataFrame:
    """``wanted`` with a free ``key`` for each row: the base, then the base with letters, then with numbers."""
    named = wanted.withColumn("_n", F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1)
    used = taken.select(F.col("key").alias("_key")).distinct()
    own = named.groupBy(base).agg(F.count("*").alias("_want"))
    # Only a taken key that is a base with one letter or a number after it can stand in the way.
    base_of = lambda k: F.array_distinct(F.array(k, F.regexp_replace(k, "[a-z]$", ""), F.regexp_replace(k, r"\d+$", "")))
    near = used.select("_key", F.explode(base_of(F.col("_key"))).alias(base)).join(own, base, "left_semi").groupBy(base).agg(F.collect_set("_key").alias("_used"))
    free = own.join(near, base, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<string>")))
    names = F.filter(F.transform(F.sequence(F.lit(0), (F.col("_want") + F.size("_used")).cast("int")), lambda i: F.concat(F.col(base), suffix(i))), lambda k: ~F.array_contains("_used", k))
    free = free.select(F.col(base).alias("_base"), names.alias("_names"))
    return named.join(free, named[base] == free["_base"]).withColumn("key", F.get("_names", F.col("_n"))).drop("_n", "_base", "_names")


def _rarest_first(sets: DataFrame, spread: DataFrame, threshold: float) -> DataFrame:
    """tokens, _n, _p, _t of token sets: their number, and of the rarest tokens as many as must hold one that a match shares."""
    # Of n tokens a match shares at least n t / (2 - t), so one of those is among all but that many less one.
    shared = F.greatest(F.lit(1), F.ceil(F.size("tokens") * (threshold / (2 - threshold)) - 1e-9))
    held = sets.select("tokens", F.explode("tokens").alias("_t")).join(spread, "_t", "left")
    ordered = held.groupBy("tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0).cast("long")).alias("_df"), "_t"))), lambda x: x["_t"]).alias("_o"))
    ordered = ordered.select("tokens", F.size("tokens").alias("_n"), F.slice("_o", F.lit(1), (F.size("tokens") - shared + 1).cast("int")).alias("_p"))
    return ordered.select("tokens", "_n", "_p", F.explode("_p").alias("_t"))


def best_title_matches(queries: DataFrame, candidates: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """id, cand, similarity: each query title's best candidate; ties by citations, then candidate id.

    Of candidates with one title, one token set or one slug only the first in that order can win, so sets are compared, not
    rows. Sets meet by equi-join on their rarest tokens, and only where the token counts allow the threshold; equal slugs
    count as 1 even without a shared token. Both sides have id or cand and title; candidates have citation_count.
    """
    rank = F.struct((-F.coalesce("citation_count", F.lit(0))).alias("_down"), "cand")
    named = lambda d, *more: d.select(*more, F.array_sort(title_tokens(F.col("title"))).alias("tokens"), slug(F.col("title"), 200).alias("_slug"))
    q = named(queries, "id")
    c = staged(named(candidates.groupBy("title").agg(F.min(rank).alias("_best")), "_best"), "titles")
    sets = staged(c.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("_best").alias("_best")), "title-sets")
    spread = sets.select(F.explode("tokens").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df"))
    mine = _rarest_first(q.where(F.size("tokens") > 0).select("tokens").distinct(), spread, threshold).withColumnsRenamed({"tokens": "_q", "_n": "_nq", "_p": "_pq"})
    theirs = _rarest_first(sets.select("tokens"), spread, threshold)
    # F1 of at least t bounds the ratio of the sizes; a pair of sets counts at the first token by which it meets.
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    met = mine.join(theirs, "_t").where((F.col("_n") >= F.col("_nq") * low - 1e-9) & (F.col("_n") <= F.col("_nq") * high + 1e-9) & (F.get(F.array_intersect("_pq", "_p"), F.lit(0)) == F.col("_t")))
    f1 = 2.0 * F.size(F.array_intersect("_q", "tokens")) / (F.col("_nq") + F.col("_n"))
    scored = met.select("_q", "tokens", f1.alias("similarity")).where(F.col("similarity") >= threshold).join(sets, "tokens")
    order = lambda similarity: F.struct((-similarity).alias("_least"), "_best._down", "_best.cand")
    by_set = scored.groupBy(F.col("_q").alias("tokens")).agg(F.min(order(F.col("similarity"))).alias("_by_set"))
    by_slug = c.where("_slug <> ''").groupBy("_slug").agg(F.min("_best").alias("_best")).select("_slug", order(F.lit(1.0)).alias("_by_slug"))
    best = q.join(by_set, "tokens", "left").join(by_slug, "_slug", "left").select("id", F.least("_by_set", "_by_slug").alias("b")).where("b is not null")
    return best.select("id", F.col("b.cand").alias("cand"), (-F.col("b._least")).alias("similarity"))


def match_cascade(items: DataFrame, entries: DataFrame) -> DataFrame:
    """id, key, how: dropped files matched to entries: by identifier, by title, then by file name; unread ones first.

    Items have id, doi, arxiv_id, title and stem; of several matches the one of the first way and key counts.
    """
    unread = F.col("status") != "verified"
    known = entries.select("key", "doi", "arxiv_id", "title", unread.alias("_open"))
    ids = known.select("key", "_open", F.explode(identities(F.col("doi"), F.col("arxiv_id"), F.col("title"))).alias("_i")).select("key", "_open", "_i.kind", "_i.value")
    names = known.select("key", F.lit(True).alias("_open"), F.lit("stem").alias("kind"), slug(F.col("key"), 200).alias("value"))
    asked = items.select("id", F.explode(F.concat(identities(F.col("doi"), F.col("arxiv_id"), F.col("title")), F.array(F.struct(F.lit("stem").alias("kind"), slug(F.col("stem"), 200).alias("value"))))).alias("_i")).select("id", "_i.kind", "_i.value")
    by_id = F.col("kind").isin("doi", "arxiv")
    place = F.when(by_id & F.col("_open"), 1).when(by_id, 2).when((F.col("kind") == "title") & F.col("_open"), 3).when(F.col("kind") == "title", 4).otherwise(5)
    # Many entries may share an identity; only the first in the order of ways and keys can win, so that is all that is joined.
    first = ids.unionByName(names).where("value <> ''").groupBy("kind", "value").agg(F.min(F.struct(place.alias("_way"), "key")).alias("_b"))
    best = asked.where("value <> ''").join(first, ["kind", "value"]).groupBy("id").agg(F.min("_b").alias("_b"))
    return best.select("id", F.col("_b.key").alias("key"), F.get(F.array(*[F.lit(x) for x in ("", "unread by id", "any by id", "unread by title", "any by title", "file name")]), F.col("_b._way")).alias("how"))


def similar(a: Column, b: Column, threshold: float = 0.85) -> Column:
    return token_f1(title_tokens(a), title_tokens(b)) >= threshold
