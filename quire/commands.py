"""The commands that need answers from outside: each runs a dataflow over a library and writes what it changes.

Answers are tables in a folder, ``NAME.parquet`` or ``NAME.json`` (JSON lines), filled by whatever asks models and
indexes. A table that is missing is empty: the command does what it can without it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.library import Library, libraries
from quire.operators import actions, maintain
from quire.operators.search import backlog
from quire.plans.planning import SearchPlan, unplanned
from quire.plans.providers import Tables
from quire.schema import ENTRY, RECORD, REFERENCE, SECTION
from quire.sources import files
from quire.sources.storage import staged

#: What may lie in the folder; the last four are answers of roles. A reader's key is the work's for ``add``, else the entry's.
TABLES = {
    "records": RECORD,
    "fulltexts": "doc string, text string, pages int, pages_read int",
    "fresh": f"key string, citation_count bigint, references array<{REFERENCE}>, doi string, venue string, bibtex string, abstract string",
    "files": "id string, stem string, text string",
    "links": "key string, url string, official boolean, reachable string, confidence string, evidence string",
    "verdicts": "citing string, cited string, ord int, confidence double, states_claim boolean, is_origin boolean, readable boolean, year int, title string, doi string, arxiv_id string",
    "rank": "dedup_key string, score double",
    "reader": f"key string, one_liner string, sections array<{SECTION}>, key_findings array<string>, tags array<string>, code_url string",
    "evidence": "key string, relevant boolean, summary string, quotes array<string>",
    "check": "key string, field string, proposed string, source string",
}
ROLES = ("rank", "reader", "evidence", "check")


def as_entries(rows: DataFrame) -> DataFrame:
    """``rows`` with exactly an entry's columns; what they lack is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ENTRY)])


class Desk:
    """A library beside a folder of answers."""

    def __init__(self, library: Library, folder: str | None, year: int):
        self.library, self.folder, self.year = library, folder, year

    def _there(self, name: str) -> str | None:
        if self.folder:
            for form in ("parquet", "json"):
                store, path = files.opened(f"{self.folder}/{name}.{form}")
                if store.get_file_info(path).type.name in ("File", "Directory"):
                    return form
        return None

    def table(self, name: str) -> DataFrame:
        form, spark = self._there(name), self.library.spark
        if not form:
            return spark.createDataFrame([], TABLES[name])
        return spark.read.schema(TABLES[name]).format(form).load(f"{self.folder}/{name}.{form}")

    def provider(self) -> Tables:
        return Tables(**{r: self.table(r) for r in ROLES if self._there(r)})

    def _entries(self) -> DataFrame:
        return as_entries(self.library.entries())

    def _save(self, rows: DataFrame) -> None:
        self.library.save(as_entries(rows))

    def find(self, query: str, limit: int = 10, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        """Ranked candidates from the library's references and the records."""
        plan = unplanned(query) if not (year_from or year_to) else SearchPlan(query, query, (query,), (), year_from, year_to)
        found = actions.as_candidates(self.table("records"), "search", "search")
        return actions.discover(self._entries(), found, plan, self.year, limit=limit, provider=self.provider())

    def siblings(self) -> DataFrame | None:
        """Entries of the other libraries beside this one; null if there are none."""
        root, own = self.library.folder.rsplit("/", 1)
        others = [n for n in libraries(self.library.spark, root) if n != own]
        rows = [Library(self.library.spark, f"{root}/{n}").entries().select(F.lit(n).alias("library"), "key", "doi", "arxiv_id", "title", "status", "one_liner") for n in others]
        return reduce(DataFrame.unionByName, rows) if rows else None

    def add(self, min_level: str | None = None, read: bool = True, refresh: bool = False) -> DataFrame:
        """Drafts entries of the records, reads those that a reader answered and saves what is admitted; with ``refresh`` known works too."""
        settings = self.library.settings
        merged = maintain.merged_records(self.table("records"))
        # A work has no key before it is added: the reader's answers name the work.
        answers = Tables(**({"reader": self.table("reader").withColumnRenamed("key", "work")} if self._there("reader") else {}))
        done = staged(actions.add_papers(self._entries(), merged, self.table("fulltexts"), self.year, min_level=min_level or settings.min_level, allow_non_published=settings.allow_non_published, provider=answers, read=read, refresh=refresh, siblings=self.siblings()), "add")
        dates = self._entries().select("key", "added")
        self._save(done.where("outcome in ('added', 'updated')").join(dates, "key", "left"))
        return done.select("work", "key", "outcome", "reason", "status", "elsewhere")

    def read(self, *keys: str, again: bool = False, level: str | None = None, tag: str | None = None) -> DataFrame:
        """Takes the reader's answers into unread entries; with ``again`` into read ones too."""
        rows = self._entries()
        rows = rows.where(F.col("key").isin(*keys)) if keys else rows
        # Fixed before entries are written: what was read is no backlog afterwards.
        rows = staged(rows if again else backlog(rows, level=level, tag=tag), "read")
        texts = self.table("fulltexts").groupBy(F.col("doc").alias("key")).agg(F.first("text").alias("text"))
        answers = self.table("reader").join(rows.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(texts, "key", "left")
        done = staged(actions.apply_reading(rows.join(answers.select("key"), "key", "left_semi"), answers), "read")
        self._save(done)
        return rows.select("key").join(done.select("key", "status", "one_liner"), "key", "left").select("key", F.coalesce("status", F.lit("no answer")).alias("status"), "one_liner")

    def refresh(self) -> DataFrame:
        """Takes fresh counts, references and gap fillers from index records."""
        done = staged(maintain.refreshed(self._entries(), self.table("fresh")).where(F.size("changes") > 0), "refresh")
        self._save(done.drop("changes"))
        return done.select("key", F.array_join("changes", "; ").alias("changes"))

    def check(self, fix: bool = False) -> DataFrame:
        """Audits entries, asks for corrections and, with ``fix``, saves them."""
        entries, fresh = staged(self._entries(), "check"), self.table("fresh")
        report = staged(actions.check_entries(entries, fresh, self.year, fix=fix, provider=self.provider()), "check")
        if fix:
            self._save(actions.corrected(entries, fresh, actions.corrections(entries, self.year, self.provider())).where("changed > 0"))
        return report

    def inbox(self) -> DataFrame:
        """Which entries the dropped files belong to."""
        return actions.drain_inbox(self.table("files"), self._entries())

    def code(self, force: bool = False, unofficial: bool = False) -> DataFrame:
        """Saves repository links that a search found and that hold."""
        entries = self._entries()
        done = staged(actions.find_code(entries, self.table("links"), force=force, unofficial=unofficial), "code")
        new = done.where("status = 'found'").select("key", F.col("code_url").alias("_url"), F.col("reason").alias("_reason"))
        self._save(entries.join(new, "key").withColumns({"code_url": F.col("_url"), "code_source": F.lit("web"), "code_reason": F.col("_reason")}))
        return done

    def ask(self, question: str, read: int = 5, **filters) -> DataFrame:
        """One row of Markdown: what the best entries say to a question, and where."""
        entries = self._entries()
        evidence = actions.ask(entries, question, self.table("fulltexts"), self.provider(), read=read, **filters)
        return actions.answer_markdown(question, evidence, entries)

    def claim(self, *keys: str) -> DataFrame:
        """Walks from the given entries to where a claim was first made, along judged references."""
        starts = self.library.spark.createDataFrame([(k,) for k in keys], "node string")
        return actions.trace_claim(starts, self.table("verdicts")).orderBy("start", "hop")


def run(a, library: Library, year: int) -> DataFrame:
    """The command that the parsed arguments name."""
    desk = Desk(library, a.tables, year)
    keep = lambda *names: {n: v for n in names if (v := getattr(a, n, None)) is not None}
    calls = {
        "find": lambda: desk.find(a.query, **keep("limit", "year_from", "year_to")).select("dedup_key", "rank", "relevance", "year", "title"),
        "add": lambda: desk.add(a.min_level, not a.no_read, a.refresh), "read": lambda: desk.read(*a.keys, **keep("level", "tag")), "reread": lambda: desk.read(*a.keys, again=True), "refresh": desk.refresh, "check": lambda: desk.check(a.fix),
        "inbox": lambda: desk.inbox().select("id", "key", "how", "status", "title"), "code": lambda: desk.code(a.force, a.unofficial), "ask": lambda: desk.ask(a.question, **keep("read", "level", "tag", "year_from", "year_to")), "claim": lambda: desk.claim(*a.keys),
    }
    return calls[a.command]()


#: Commands of ``run``.
NAMES = ("find", "add", "read", "reread", "refresh", "check", "inbox", "code", "ask", "claim")
