"""Schemas of the bibliographic tables."""

from __future__ import annotations

REFERENCE = "struct<title: string, year: int, doi: string, arxiv_id: string, authors: array<string>, key: string>"
SECTION = "struct<name: string, summary: string>"

#: One row a library entry.
ENTRY = f"""
key string, title string, authors array<string>, year int, venue string, type string, doi string, arxiv_id string,
url string, code_url string, code_source string, code_reason string, status string, level string, level_reason string,
check_note string, abstract string, one_liner string, sections array<{SECTION}>, tags array<string>,
key_findings array<string>, citation_count bigint, references array<{REFERENCE}>, bibtex string, read_source string,
pdf_path string, text_chars bigint, pages int, pages_read int, added string, updated string, notes string
""".replace("\n", " ")

#: One row a source record of a work, before records are merged.
RECORD = f"""
work string, priority int, title string, authors array<string>, year int, venue string, type string, doi string,
arxiv_id string, url string, pdf_url string, pmcid string, abstract string, citation_count bigint, bibtex string,
references array<{REFERENCE}>, source string, title_matched boolean
""".replace("\n", " ")

#: One row a candidate paper of a search.
CANDIDATE = """
arrival bigint, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string,
why string, angles array<string>, citation_count bigint, cocitations int, source string, level string, relevance double
""".replace("\n", " ")

# Fixed values of the entry model.
LEVELS = ("A*", "A", "B", "C", "unranked")
TYPES = ("conference paper", "journal article", "workshop paper", "preprint", "book", "book chapter", "thesis", "report", "video", "other")
VERIFIED, UNVERIFIED, UNREAD = "verified", "UNVERIFIED", "unread"
FROM_PAPER, FROM_WEB = "paper", "web"
SCHEMA_VERSION = 3
