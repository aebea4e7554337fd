"""A library of entry files with its index: the commands of the tool as methods."""

from __future__ import annotations

import datetime as dt
import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.identifiers import library_name
from quire.operators import export, identity, maintain
from quire.operators import search as searching
from quire.operators.segments import SegmentedIndex
from quire.plans.planning import Settings
from quire.schema import SCHEMA_VERSION
from quire.sources import entryfiles, files
from quire.sources.storage import staged

#: How the stored terms of an index are made; another number rebuilds it.
TERMS = 2
#: Changed files that are named to the reader; more are found by a join.
NAMED_FILES = 1000


class Library:
    """``entries/*.md`` under a folder are the truth; ``index`` is derived and can be rebuilt."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = settings or self._load()

    # -- settings --------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, scope: str = "", **settings) -> Library:
        """A new folder with settings; ValueError if it is there."""
        clean = spark.range(1).select(library_name(F.lit(name))).first()[0]
        if not clean:
            raise ValueError(f"{name!r} names no folder")
        store, path = files.opened(f"{root}/{clean}")
        if store.get_file_info(f"{path}/library.json").is_file:
            raise ValueError(f"{path} is a library already")
        store.create_dir(f"{path}/entries", recursive=True)
        library = cls(spark, f"{root}/{clean}", Settings(clean, scope, dt.date.today().isoformat(), **settings))
        library.save_settings()
        return library

    def _load(self) -> Settings:
        store, path = files.opened(self.folder)
        with store.open_input_stream(f"{path}/library.json") as f:
            return Settings(**json.loads(f.read()))

    def save_settings(self, **changes) -> None:
        self.settings = self.settings.changed(**changes)
        store, path = files.opened(self.folder)
        with store.open_output_stream(f"{path}/library.json") as f:
            f.write(json.dumps(self.settings.__dict__).encode())

    # -- reading ---------------------------------------------------------------------------------------------

    @property
    def entries_folder(self) -> str:
        return f"{self.folder}/entries"

    def entries(self) -> DataFrame:
        return entryfiles.read_entries(self.spark, self.entries_folder)

    def corrupt(self) -> DataFrame:
        return entryfiles.read_entries(self.spark, self.entries_folder, corrupt=True)

    def keys(self) -> list[str]:
        return [r["key"] for r in entryfiles.keys(self.spark, self.entries_folder).collect()]

    def __len__(self) -> int:
        return entryfiles.keys(self.spark, self.entries_folder).count()

    def get(self, *keys: str) -> DataFrame:
        return self.entries().where(F.col("key").isin(*keys))

    def has(self, key: str) -> bool:
        return self.get(key).limit(1).count() > 0

    def ls(self, **options) -> DataFrame:
        return searching.listed(self.entries(), **options)

    def search(self, query: str, **options) -> DataFrame:
        """The best entries; word forms do not matter unless ``stem=False``, which searches without the stored terms."""
        rows = self.indexed()
        if options.get("stem") is not False:
            options["index"] = self.index
        return searching.search(rows, query, **options)

    def show(self, *keys: str, brief: bool = False) -> DataFrame:
        return export.card(self.get(*keys), brief=brief)

    def cite(self, *keys: str, form: str = "bibtex", **filters) -> DataFrame:
        rows = searching.matching(self.get(*keys) if keys else self.entries(), **filters)
        return export.cited(rows, form)

    def info(self) -> DataFrame:
        return maintain.statistics(self.entries())

    def backlog(self, **options) -> DataFrame:
        return searching.backlog(self.entries(), **options)

    # -- writing ---------------------------------------------------------------------------------------------

    def save(self, entries: DataFrame) -> int:
        """Writes entries with the notes that are on disk and today's date."""
        today = dt.date.today().isoformat()
        rows = maintain.saved(self.entries(), entries) if len(self) else entries
        rows = rows.withColumns({"updated": F.lit(today), "added": F.coalesce(F.nullif("added", F.lit("")), F.lit(today))})
        # Files that are read are also overwritten: the rows are fixed first.

        return entryfiles.write_entries(staged(rows, "save"), self.entries_folder)

    def set_notes(self, key: str, notes: str, *, append: bool = False) -> bool:
        """The only writer of notes; false if there is no such entry."""

        text = F.concat_ws("\n\n", F.nullif("notes", F.lit("")), F.lit(notes)) if append else F.lit(notes)
        rows = staged(self.get(key).withColumn("notes", text), "notes")
        return entryfiles.write_entries(rows, self.entries_folder) > 0

    def delete(self, *keys: str) -> int:
        """All or nothing: ValueError if one of them is not there."""
        held = entryfiles.keys(self.spark, self.entries_folder).where(F.col("key").isin(*keys)).collect()
        missing = set(keys) - {r["key"] for r in held}
        if missing:
            raise ValueError(f"no such entries: {', '.join(sorted(missing))}")
        return files.delete_files(self.entries_folder, [f"{k}.md" for k in keys])

    def unique_key(self, base: str) -> str:
        wanted = self.spark.createDataFrame([(1, base)], "id int, base string")
        return identity.unique_keys(wanted, entryfiles.keys(self.spark, self.entries_folder)).first()["key"]

    # -- index -----------------------------------------------------------------------------------------------

    @property
    def index(self) -> SegmentedIndex:
        """Stored terms and rows of the entries; another schema or way of making terms has a folder of its own."""
        folder = f"{self.folder}/index/schema-{SCHEMA_VERSION}-terms-{TERMS}"
        return SegmentedIndex(self.spark, folder, searching.FIELD_WEIGHTS, fold=True, stem=True, positions=True, payload=("row",))

    def indexed(self) -> DataFrame:
        """The entries of the index, brought up to date first."""
        self.sync()
        return self.index.documents().select("row.*") if self.index.manifest().segments else self.entries()

    def sync(self, force: bool = False) -> int:
        """Takes new, changed and vanished files into the index as one segment; how many entries. Other files are not read.

        With ``force`` every file is taken anew, and what no reader can still need is deleted.
        """
        index, now = self.index, entryfiles.listed_files(self.spark, self.entries_folder)
        some = bool(index.manifest().segments)
        held = index.documents().select("key", F.col("row.path").alias("path"), F.col("row.mtime").alias("_mtime")) if some else self.spark.createDataFrame([], "key string, path string, _mtime double")
        both = now.join(held, "path", "full_outer")
        changed = F.col("_mtime").isNull() | (F.abs(F.col("mtime") - F.col("_mtime")) >= 1e-6) | F.lit(force)
        diff = staged(both.select("path", "key", F.col("mtime").isNull().alias("vanished"), changed.alias("changed")).where("vanished or changed"), "sync")
        paths = diff.where("not vanished").select("path").distinct()
        # Few files are named to the reader; many are found again by a join.
        named = [r["path"] for r in paths.limit(NAMED_FILES + 1).collect()]
        if len(named) > NAMED_FILES:
            rows = self.entries().join(paths, "path", "left_semi")
        elif named:
            rows = entryfiles.read_entries(self.spark, [unquote(p) for p in named])
        else:
            rows = None
        if rows is None and diff.isEmpty():
            return 0
        fresh = staged(rows if rows is not None else self.entries().limit(0), "sync-rows")
        # A file that can no longer be read keeps its entry.
        gone = diff.where("vanished").select("key").unionByName(diff.join(fresh.select("path"), "path", "left_semi").select("key")).where("key is not null")
        gone = staged(gone.join(fresh.select("key"), "key", "left_anti").distinct(), "sync-gone")
        count = fresh.count() + gone.count()
        if not count:
            return 0
        index.apply(searching.entry_fields(fresh.withColumn("row", F.struct(*fresh.columns)), "row"), gone)
        while index.compact():
            pass
        if force:
            index.vacuum()
        return count

    # -- exchange --------------------------------------------------------------------------------------------

    def export(self, path: str, keys: list[str] | None = None) -> int:
        """A bundle: the entries as Parquet and a manifest; never the index."""
        rows = (self.get(*keys) if keys else self.entries()).drop("path", "mtime")
        rows.write.mode("overwrite").parquet(f"{path}/entries")
        n = self.spark.read.parquet(f"{path}/entries").count()
        store, base = files.opened(path)
        with store.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps({"format": 1, "library": self.settings.name, "scope": self.settings.scope, "entries": n}).encode())
        return n

    def peek(self, path: str) -> dict:
        """A bundle's manifest; one is made up for a bundle without."""
        store, base = files.opened(path)
        if not store.get_file_info(f"{base}/manifest.json").is_file:
            return {"format": 0, "library": "import", "entries": self.spark.read.parquet(f"{path}/entries").count()}
        with store.open_input_stream(f"{base}/manifest.json") as f:
            return json.loads(f.read())

    def import_bundle(self, path: str, strategy: str = "newer") -> DataFrame:
        """Merges a bundle; key, incoming, outcome and reason of each of its entries."""

        theirs = self.spark.read.parquet(f"{path}/entries")
        mine = self.entries().select(*theirs.columns) if len(self) else theirs.limit(0)
        merged = staged(maintain.imported(mine, theirs, strategy=strategy, library=self.peek(path)["library"]), "import")
        kept = merged.where("outcome <> 'skipped'").select(F.col("incoming").alias("_incoming"), F.col("key").alias("_key"), F.col("notes").alias("_notes"), F.col("added").alias("_added"))
        clash = merged.where("outcome = 'added' and key_taken").select(F.col("incoming").alias("id"), F.col("key").alias("base"))
        fresh = identity.unique_keys(clash, mine.select("key")).select(F.col("id").alias("_id"), F.col("key").alias("_fresh"))
        rows = theirs.join(kept, theirs["key"] == kept["_incoming"]).join(fresh, theirs["key"] == fresh["_id"], "left")
        rows = rows.withColumns({"key": F.coalesce("_fresh", "_key"), "notes": F.col("_notes"), "added": F.col("_added")}).select(*theirs.columns)
        entryfiles.write_entries(staged(rows, "import-rows"), self.entries_folder)
        return merged.select("key", "incoming", "outcome", "reason")


def libraries(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` that hold settings, sorted."""
    from pyarrow import fs

    store, path = files.opened(root)
    found = store.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and store.get_file_info(f"{f.path}/library.json").is_file)


def resolve(spark: SparkSession, root: str, name: str | None = None, default: str | None = None) -> Library:
    """The named library, the default or the only one; ValueError otherwise."""
    names = libraries(spark, root)
    chosen = name or default or (names[0] if len(names) == 1 else None)
    if chosen not in names:
        raise ValueError(f"no library {chosen!r} among {names}" if chosen else f"choose one of {names}")
    return Library(spark, f"{root}/{chosen}")
