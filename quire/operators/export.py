"""Citations and cards: BibTeX, Markdown, keys, JSON, and the text forms of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.documents import snippet
from quire.functions.identifiers import code_provenance

# BibTeX kinds of entry types, and what cards may hold.
KINDS = {"conference paper": "inproceedings", "workshop paper": "inproceedings", "journal article": "article", "book": "book", "book chapter": "incollection", "thesis": "phdthesis", "report": "techreport"}
CARD_SECTIONS, CARD_CHARS, CARD_FINDINGS = 6, 180, 6


def _when_filled(c: Column, out: Column) -> Column:
    return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", out)


def bibtex(key: Column, kind: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, arxiv_id: Column, url: Column) -> Column:
    """A BibTeX record with the fields that are there."""
    kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    form = F.coalesce(F.try_element_at(kinds, kind), F.lit("misc"))
    field = lambda name, value: _when_filled(value, F.concat(F.lit(f"  {name} = {{"), value.cast("string"), F.lit("}")))
    place = _when_filled(venue, F.concat(F.lit("  "), F.when(form == "article", "journal").otherwise("booktitle"), F.lit(" = {"), venue, F.lit("}")))
    eprint = _when_filled(arxiv_id, F.concat(F.lit("  eprint = {"), arxiv_id, F.lit("},\n  archivePrefix = {arXiv}")))
    body = F.concat_ws(",\n", field("title", title), field("author", F.array_join(authors, " and ")), field("year", F.nullif(year, F.lit(0))), place, field("doi", doi), eprint, field("url", url))
    return F.concat(F.lit("@"), form, F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}"))


def citation(authors: Column, venue: Column, year: Column, arxiv_id: Column | None = None) -> Column:
    """'First et al., Venue, Year'."""
    who = F.concat(F.get(authors, F.lit(0)), F.when(F.size(authors) > 1, " et al.").otherwise(""))
    where = F.nullif(venue, F.lit("")) if arxiv_id is None else F.coalesce(F.nullif(venue, F.lit("")), F.when(F.coalesce(arxiv_id, F.lit("")) != "", "arXiv"))
    return F.concat_ws(", ", who, where, F.nullif(year, F.lit(0)).cast("string"))


def citation_order() -> list[Column]:
    """By the first author's last name, then year."""
    last = F.lower(F.try_element_at(F.split(F.get("authors", F.lit(0)), r"\s+"), F.lit(-1)))
    return [F.coalesce(last, F.lit("")), F.coalesce("year", F.lit(0)), F.col("key")]


def sections_markdown(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("### "), s["name"], F.lit("\n\n"), s["summary"])), "\n\n")


def coverage(pages: Column, read: Column) -> Column:
    p, r = F.coalesce(pages, F.lit(0)), F.coalesce(read, F.lit(0))
    return F.when(p == 0, "").when((r > 0) & (r < p), F.concat(r.cast("string"), F.lit(" of "), p.cast("string"), F.lit(" pages (sampled)"))).otherwise(F.concat(p.cast("string"), F.lit(" pages (complete)")))


def paper_url(url: Column, doi: Column, arxiv_id: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(url), F.concat(F.lit("https://doi.org/"), some(doi)), F.concat(F.lit("https://arxiv.org/abs/"), some(arxiv_id)))


def card(entries: DataFrame, *, brief: bool = False) -> DataFrame:
    """key, card: what a judge reads of an entry, bounded whatever the entry holds."""
    line = lambda name, value: _when_filled(value, F.concat(F.lit(name + ": "), value))
    parts = [F.concat(F.lit("["), F.col("key"), F.lit("] "), F.col("title")), citation(F.col("authors"), F.col("venue"), F.col("year"), F.col("arxiv_id")), line("level", F.col("level")), line("tags", F.array_join("tags", ", ")), line("summary", snippet(F.coalesce(F.nullif("one_liner", F.lit("")), "abstract"), 400))]
    if not brief:
        sections = F.array_join(F.transform(F.slice("sections", 1, CARD_SECTIONS), lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), snippet(s["summary"], CARD_CHARS))), "\n")
        findings = F.array_join(F.transform(F.slice("key_findings", 1, CARD_FINDINGS), lambda x: F.concat(F.lit("* "), snippet(x, CARD_CHARS))), "\n")
        parts += [F.nullif(sections, F.lit("")), F.nullif(findings, F.lit("")), line("notes", snippet(F.col("notes"), 300)), line("code", F.concat_ws(", ", F.nullif("code_url", F.lit("")), F.nullif(code_provenance(F.col("code_url"), F.col("code_source")), F.lit(""))))]
    return entries.select("key", F.concat_ws("\n", *parts).alias("card"))


def cited(entries: DataFrame, form: str = "bibtex") -> DataFrame:
    """key, text of entries in citation order: bibtex, markdown, json or keys."""
    c = F.col
    made = bibtex(c("key"), c("type"), c("title"), c("authors"), c("year"), c("venue"), c("doi"), c("arxiv_id"), c("url"))
    forms = {
        "bibtex": F.coalesce(F.nullif("bibtex", F.lit("")), made),
        "markdown": F.concat(F.lit("- **"), c("title"), F.lit("** — "), citation(c("authors"), c("venue"), c("year"), c("arxiv_id")), F.coalesce(F.concat(F.lit(" <"), paper_url(c("url"), c("doi"), c("arxiv_id")), F.lit(">")), F.lit(""))),
        "json": F.to_json(F.struct("key", "title", "authors", "year", "venue", "type", "doi", "arxiv_id", "url", "level", "status", "tags", "citation_count")),
        "keys": c("key"),
    }
    return entries.orderBy(*citation_order()).select("key", forms[form].alias("text"))


def bibliography(answers: DataFrame) -> DataFrame:
    """The entries that an answer quotes: relevant ones with a quote."""
    return answers.where(F.col("relevant") & (F.size("quotes") > 0))
