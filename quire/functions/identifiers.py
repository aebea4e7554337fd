"""Identifiers and names as column expressions: DOI, arXiv id, code URL, slugs, keys, tags, targets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns, code hosts and words that citation keys skip.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:a-z0-9<>\[\]]+"
ARXIV_NEW = r"(\d{4}\.\d{4,5})(v\d+)?"
ARXIV_OLD = r"(?i)([a-z-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?"
CODE_HOSTS = (
    "github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "gitee.com", "sourceforge.net", "git.sr.ht", "savannah.gnu.org",
    "huggingface.co", "zenodo.org", "figshare.com", "osf.io", "codeocean.com", "softwareheritage.org", "dataverse.harvard.edu",
)
OWNER_REPO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "gitee.com")
KEY_STOPWORDS = ("a", "an", "the", "on", "in", "of", "for", "and", "to", "with", "is", "are", "at", "by", "from", "via", "using")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def normal_doi(raw: Column) -> Column:
    """The bare lower-case DOI in a string or URL."""
    return blank_to_null(F.regexp_replace(F.lower(F.regexp_extract(raw, DOI, 0)), r"[.,;)]+$", ""))


def normal_arxiv(raw: Column) -> Column:
    """The arXiv id without its version; the new scheme is tried first."""
    return F.coalesce(blank_to_null(F.regexp_extract(raw, ARXIV_NEW, 1)), blank_to_null(F.regexp_extract(raw, ARXIV_OLD, 1)))


def arxiv_year(arxiv_id: Column) -> Column:
    """The year that an arXiv id states; two-digit years of the old scheme turn at 91."""
    new, old = F.regexp_extract(arxiv_id, r"^(\d{2})\d{2}\.\d{4,5}", 1), F.regexp_extract(arxiv_id, r"/(\d{2})\d{5}", 1)
    short = old.try_cast("int")
    return F.coalesce(2000 + new.try_cast("int"), F.when(short >= 91, 1900 + short).otherwise(2000 + short))


def normal_code_url(raw: Column) -> Column:
    """An https URL of a repository on a known host, null for anything else."""
    s = F.btrim(F.btrim(raw, F.lit(" \t\r\n\f\x0b")), F.lit("<>()[]{}.,;:'\""))
    s = F.when(s.rlike(r"(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), F.ltrim(s, F.lit("/"))))
    s = F.when((s != "https://") & ~F.contains(s, F.lit(" ")), s)
    host = F.regexp_replace(F.lower(F.regexp_extract(s, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.array_remove(F.split(F.regexp_extract(s, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/"), "")
    query = F.regexp_extract(s, r"^[^#?]*(\?[^#]+)", 1)
    known = host.rlike("(^|\\.)(" + "|".join(h.replace(".", r"\.") for h in CODE_HOSTS) + ")$")
    enough = F.size(path) >= F.when(host.isin(*OWNER_REPO_HOSTS), 2).otherwise(1)
    return F.when(known & enough, F.concat(F.lit("https://"), host, F.lit("/"), F.array_join(path, "/"), query))


def latin_fold(start: int = 0xA0, end: int = 0x250) -> tuple[str, str]:
    """Letters (up to U+024F) that decompose to one ASCII character, and those characters; derived, not listed."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(start, end)]
    kept = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_FROM, _TO = latin_fold()


def ascii_fold(text: Column) -> Column:
    """Accents off, by a translation table: no Python on the way. Combining marks go; other letters stay for the caller."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(F.translate(t, _FROM, _TO), r"\p{M}+", ""))


def slug(text: Column, size: int = 40) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.substring(F.lower(F.regexp_replace(ascii_fold(text), "[^a-zA-Z0-9]+", "")), 1, size)


def folded(text: Column) -> Column:
    """What verbatim containment is tested on: lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """Surname, year and first title word that means something."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    spaced = F.array_remove(F.split(first, r"\s+"), "")
    surname = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.coalesce(F.try_element_at(spaced, F.lit(-1)), F.lit("")))
    surname = F.coalesce(blank_to_null(slug(surname, 20)), F.lit("anon"))
    found = F.regexp_extract_all(ascii_fold(title), F.lit("([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    word = F.get(F.filter(found, lambda w: ~F.lower(w).isin(*KEY_STOPWORDS)), F.lit(0))
    return F.concat(surname, F.coalesce(F.when(year != 0, year.cast("string")), F.lit("")), F.coalesce(slug(word, 20), F.lit("")))


def identity(doi: Column, arxiv_id: Column, title: Column, size: int = 120) -> Column:
    """What two records of one work share: DOI, else arXiv id, else slug of the title."""
    return F.coalesce(blank_to_null(doi), F.concat(F.lit("arxiv:"), blank_to_null(arxiv_id)), slug(title, size))


def library_name(name: Column) -> Column:
    """A folder name: letters, digits, dot, dash and underscore."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9._-]+", "-"), F.lit("-"))


def escapes_library(key: Column) -> Column:
    """Whether a key would leave its folder."""
    return key.rlike(r"[/\\]|\.\.")


def normal_tags(tags: Column, limit: int = 12) -> Column:
    """Lower-case hyphenated tags, the first of equal ones, at most ``limit``."""
    clean = F.transform(tags, lambda t: F.btrim(F.regexp_replace(F.lower(F.trim(t)), r"\s+", "-"), F.lit("-")))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, limit)


def clean_strings(values: Column, limit: int, min_length: int = 1) -> Column:
    """White space collapsed, too short ones out, the first of those equal but for case, at most ``limit``."""
    flat = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: F.length(v) >= min_length)
    lowered = F.transform(flat, F.lower)
    return F.slice(F.filter(flat, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1), 1, limit)


def target(raw: Column) -> Column:
    """struct(kind, value) of what a user typed: arxiv, doi, url or title."""
    s = F.trim(raw)
    kind = (
        F.when(s.rlike(r"(?i)^arxiv:"), "arxiv")
        .when(s.rlike(r"(?i)^doi:|^https?://(dx\.)?doi\.org/"), "doi")
        .when(s.rlike(r"(?i)^https?://(www\.|export\.)?arxiv\.org/"), "arxiv")
        .when(s.rlike(r"(?i)^https?://"), "url")
        .when(s.rlike(r"(?i)^10\.\d{4,9}/\S+$"), "doi")
        .when(s.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$") | s.rlike(r"(?i)^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"), "arxiv")
        .otherwise("title")
    )
    value = F.when(kind == "arxiv", normal_arxiv(s)).when(kind == "doi", normal_doi(s)).otherwise(s)
    return F.struct(kind.alias("kind"), value.alias("value"))


def code_provenance(url: Column, source: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(source == "web", "found on the web").otherwise("printed in the paper")


def author_name(given: Column, family: Column, name: Column) -> Column:
    """'given family', else the plain name."""
    return F.coalesce(blank_to_null(F.trim(F.concat_ws(" ", given, family))), name)


def pmcid(raw: Column) -> Column:
    return blank_to_null(F.regexp_extract(raw.cast("string"), r"PMC\d+", 0))


def year_window(low: Column, high: Column) -> Column:
    """'lo-hi', 'lo-', '-hi' or empty."""
    lo, hi = F.when(low != 0, low.cast("string")), F.when(high != 0, high.cast("string"))
    return F.when(lo.isNull() & hi.isNull(), "").otherwise(F.concat(F.coalesce(lo, F.lit("")), F.lit("-"), F.coalesce(hi, F.lit(""))))
