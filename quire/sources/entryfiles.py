"""Markdown entry files as a source and a sink.

A file is front matter between ``---`` lines and sections under ``##`` headings; what follows the notes marker belongs
to the user. Front matter is written as JSON values, which are valid YAML; foreign YAML is read where PyYAML is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.functions.identifiers import escapes_library
from quire.schema import ENTRY
from quire.sources.shipping import map_batches

#: Where the user's notes begin; any tool's name may stand before the colon.
NOTES_MARKER = r"<!-- \w+:user-notes"
NOTES_BANNER = "<!-- quire:user-notes - text below this line is yours and is never rewritten -->"
NOT_AVAILABLE = "_Not available — no full text was read._"
#: Front matter in this order; the other fields are in the body.
FRONT = (
    "key title authors year venue type doi arxiv_id url code_url code_source code_reason status level level_reason check_note tags citation_count references bibtex "
    "read_source pdf_path text_chars pages pages_read added updated"
).split()
ALWAYS = ("key", "title", "status", "level", "type")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime of every entry file, without reading them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), (F.unix_micros(meta["file_modification_time"]).cast("double") / 1e6).alias("mtime"))


def read_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, mtime, stem and text of every entry file of a folder, or of the files named."""
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), F.unix_micros(meta["file_modification_time"]).cast("double").alias("_m"), F.regexp_replace(meta["file_name"], r"\.md$", "").alias("stem"), F.col("value").alias("text")).withColumn("mtime", F.col("_m") / 1e6).drop("_m")


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """The stems of the files, without reading them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return listed.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("key")).orderBy("key")


def front_and_body(text: Column) -> tuple[Column, Column]:
    """(front matter, body) of a file's text; null front matter where there is none."""
    pattern = r"(?s)^﻿?---\r?\n(.*?)\n---[^\n]*\n?(.*)$"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_extract(text, pattern, 2)


def notes_of(body: Column) -> Column:
    tail = F.regexp_extract(body, rf"(?s){NOTES_MARKER}(?:.*?-->)?(.*)$", 1)
    return F.trim(F.regexp_replace(tail, r"(?i)^\s*## notes[^\n]*\n?", ""), F.lit(" \n\r\t"))


def machine_part(body: Column) -> Column:
    return F.get(F.split(body, NOTES_MARKER), F.lit(0))


def section_text(body: Column, heading: str) -> Column:
    """The text under a ``##`` heading, up to the next one."""
    found = F.regexp_extract(F.concat(F.lit("\n"), body, F.lit("\n## ")), rf"(?is)\n## +{heading}[ \t]*\r?\n(.*?)(?=\n## )", 1)
    return F.btrim(found, F.lit(" \n\r\t"))


def bullets(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^[-*] ")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x))))


def parsed_sections(text: Column) -> Column:
    """``###`` blocks as structs; text without a heading is one section unless it says that there is none."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n### "), lambda b, i: i > 0)
    made = F.transform(blocks, lambda b: F.struct(F.trim(F.substring_index(b, "\n", 1)).alias("name"), F.btrim(F.when(F.contains(b, F.lit("\n")), F.regexp_replace(b, r"^[^\n]*\n", "")).otherwise(""), F.lit(" \n\r\t")).alias("summary")))
    lone = F.array(F.struct(F.lit("Summary").alias("name"), text.alias("summary")))
    return F.when(F.size(made) > 0, made).when((text != "") & ~text.startswith("_Not available"), lone).otherwise(F.slice(lone, 1, 0))


def _front_matter(text: str) -> dict | None:
    """A mapping, null if the front matter is none."""
    try:
        return {k: json.loads(v) for k, v in (line.split(": ", 1) for line in text.splitlines() if line.strip())}
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return None
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    return data if isinstance(data, dict) else None


def _number(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _reference(x) -> dict | None:
    x = {"title": x} if isinstance(x, str) else x
    if not isinstance(x, dict) or not x.get("title"):
        return None
    return {"title": str(x["title"]), "year": _number(x.get("year")), "doi": x.get("doi"), "arxiv_id": x.get("arxiv_id"), "authors": [str(a) for a in x.get("authors") or []], "key": x.get("key")}


def read_entries(spark: SparkSession, folder: str | list[str], *, corrupt: bool = False) -> DataFrame:
    """Entries of a folder or of the files named; files without front matter are left out, or alone with ``corrupt``."""
    files = read_files(spark, folder)
    front, body = front_and_body(F.col("text"))
    own = machine_part(F.col("body"))
    rows = files.select("path", "mtime", "stem", front.alias("front"), body.alias("body")).select(
        "path", "mtime", "stem", "front", section_text(own, "One-line summary").alias("one_liner"), section_text(own, "Abstract").alias("abstract"), bullets(section_text(own, "Key findings")).alias("key_findings"),
        parsed_sections(section_text(own, "Detailed summary")).alias("sections"), notes_of(F.col("body")).alias("notes"),
    )
    fields = StructType(_parse_datatype_string(ENTRY).fields)
    front_schema = to_arrow_schema(StructType([fields[c] for c in FRONT]))

    def front_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, good = [], []
            for front, stem in zip(b.column("front").to_pylist(), b.column("stem").to_pylist()):
                data = _front_matter(front) if front else None
                good.append(data is not None)
                data = data or {}
                row = {c: data.get(c) for c in FRONT} | {c: _number(data.get(c)) for c in ("year", "citation_count", "text_chars", "pages", "pages_read")}
                row |= {c: [str(x) for x in data.get(c) or []] for c in ("authors", "tags")} | {"references": [r for r in map(_reference, data.get("references") or []) if r], "key": str(data.get("key") or stem)}
                row |= {c: None if row[c] is None else str(row[c]) for c in FRONT if pa.types.is_string(front_schema.field(c).type)}
                out.append(row)
            made = pa.RecordBatch.from_pylist(out, front_schema)
            yield pa.RecordBatch.from_arrays([*b.columns, *made.columns, pa.array(good, pa.bool_())], [*b.schema.names, *FRONT, "_good"])

    schema = StructType([*rows.schema.fields, *[fields[c] for c in FRONT]]).add("_good", "boolean")
    parsed = map_batches(rows, front_rows, schema)
    if corrupt:
        return parsed.where("not _good").select("path", "stem")
    return parsed.where("_good").select(*fields.names, "path", "mtime")


def rendered(entries: DataFrame) -> DataFrame:
    """key, text: entries as the text of their files."""
    lines = []
    for c in FRONT:
        kind = dict(entries.dtypes)[c]
        value = F.get_json_object(F.to_json(F.struct(F.col(c).alias("x"))), "$.x") if kind.startswith(("array", "struct")) else F.to_json(F.struct(F.col(c).alias("x")))
        value = value if kind.startswith("array") else F.regexp_extract(value, r'(?s)^\{"x":(.*)\}$', 1)
        some = F.size(c) > 0 if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        lines.append(F.when(F.lit(c in ALWAYS) | some, F.concat(F.lit(f"{c}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit("null")))))
    clean = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(" \n\r\t"))
    part = lambda name, text: F.when(text != "", F.concat(F.lit(f"\n## {name}\n\n"), text, F.lit("\n")))
    findings = F.array_join(F.transform(F.filter("key_findings", lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))), "\n")
    sections = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("### "), F.trim(s["name"]), F.lit("\n\n"), F.btrim(s["summary"], F.lit(" \n\r\t")))), "\n\n")
    sections = F.when(F.size("sections") > 0, sections).otherwise(F.when(F.col("status") != "verified", NOT_AVAILABLE).otherwise(""))
    text = F.concat(
        F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(part("One-line summary", clean("one_liner")), F.lit("")), F.coalesce(part("Abstract", clean("abstract")), F.lit("")), F.coalesce(part("Key findings", F.coalesce(findings, F.lit(""))), F.lit("")),
        F.coalesce(part("Detailed summary", sections), F.lit("")), F.lit(f"\n{NOTES_BANNER}\n\n## Notes\n\n"), clean("notes"), F.lit("\n"),
    )
    return entries.select("key", text.alias("text"))


def write_entries(entries: DataFrame, folder: str) -> int:
    """Writes a file for each entry, whole or not at all; keys that would leave the folder are refused. The number written."""
    from quire.sources.files import write_texts

    return write_texts(rendered(entries.where(~escapes_library(F.col("key")))).select(F.concat("key", F.lit(".md")).alias("name"), "text"), folder)
