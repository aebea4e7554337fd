"""Texts dropped in an inbox, filed once each: a stream of files to the entries they belong to.

A file is known by a digest of its text, so the same text is filed once under whatever names it comes. What a file says of
itself is matched with the entries of the library and the works that earlier files opened; files of one new work in a
batch open it together, under a free key. All is a batch log: a batch that comes again after a crash files nothing twice.
Moving files out of the inbox comes last and may be repeated: a file that is gone has been moved.

Statuses: added (opened a new work), updated (a work that is there got this text), repeated (this text was filed before),
unreadable (blank). Null texts are blank; within a batch the least path of equal texts, and of equal works, comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.identifiers import identity, slug
from quire.operators.actions import identified
from quire.operators.identity import match_cascade, unique_keys
from quire.sources.files import opened
from quire.sources.manifests import BatchLog
from quire.sources.shipping import map_batches
from quire.sources.storage import staged

SCHEMAS = {
    "filed": "path string, digest string, key string, how string, status string, batch int",
    "works": "key string, title string, doi string, arxiv_id string, status string, batch int",
    "texts": "key string, path string, text string",
}
KEY_CHARS = 40


class Inbox:
    """The log under ``path``; ``entries`` gives the library's entries (key, title, doi, arxiv_id, status) when a batch comes."""

    def __init__(self, spark: SparkSession, path: str, entries: Callable[[], DataFrame]):
        self.spark, self.log, self.entries = spark, BatchLog(spark, path, SCHEMAS), entries

    def apply(self, batch: int, files: DataFrame) -> bool:
        """Files a batch of (path, text); false if the batch was applied before."""
        if self.log.applied(batch):
            return False
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        said = staged(files.where("path is not null").select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.sha2("text", 256))), "inbox")
        before = self.log.read("filed").where("key is not null").groupBy("digest").agg(F.first("key").alias("_key"))
        firsts = said.where("digest is not null").groupBy("digest").agg(F.min("path").alias("_first")).join(before, "digest", "left")
        new = said.join(firsts.where("_key is null").select(F.col("_first").alias("path")), "path", "left_semi")
        items = staged(identified(new.select(F.col("path").alias("id"), stem.alias("stem"), "text")), "inbox-items")
        known = self.entries().select("key", "title", "doi", "arxiv_id", "status").unionByName(self.log.read("works").drop("batch"))
        found = staged(match_cascade(items, known), "inbox-found")
        # What nothing matches opens a work; files of one work open it together.
        open_ = items.join(found, "id", "left_anti").withColumn("_work", F.coalesce(F.nullif(identity(F.col("doi"), F.col("arxiv_id"), F.col("title")), F.lit("")), F.concat(F.lit("file:"), "stem")))
        first = open_.groupBy("_work").agg(F.min(F.struct("id", "title", "doi", "arxiv_id", "stem")).alias("f"))
        base = F.coalesce(F.nullif(slug(F.coalesce("f.title", "f.arxiv_id", "f.doi", "f.stem"), KEY_CHARS), F.lit("")), F.lit("work"))
        made = unique_keys(first.select("_work", "f", F.col("f.id").alias("id"), base.alias("base")), known.select("key"))
        made = staged(made.select("_work", "key", "f"), "inbox-works")
        works = made.select("key", F.coalesce("f.title", "f.stem").alias("title"), "f.doi", "f.arxiv_id", F.lit("unread").alias("status"), F.lit(batch).alias("batch"))
        opened_by = open_.select("id", "_work").join(made.select("_work", "key", F.col("f.id").alias("_by")), "_work")
        placed = found.select("id", "key", "how", F.lit("updated").alias("status")).unionByName(opened_by.select("id", "key", F.when(F.col("id") == F.col("_by"), "new").otherwise("same batch").alias("how"), F.when(F.col("id") == F.col("_by"), "added").otherwise("updated").alias("status")))
        placed = staged(placed, "inbox-placed")
        own = said.select("path", "digest").join(placed.withColumnRenamed("id", "path"), "path")
        by_digest = own.select("digest", F.col("key").alias("_own"))
        again = said.join(placed.select(F.col("id").alias("path")), "path", "left_anti").select("path", "digest").join(firsts.select("digest", "_key"), "digest", "left").join(by_digest, "digest", "left")
        again = again.select("path", "digest", F.coalesce("_key", "_own").alias("key"), F.when(F.col("digest").isNull(), "no text").otherwise("same text").alias("how"), F.when(F.col("digest").isNull(), "unreadable").otherwise("repeated").alias("status"))
        filed = own.select("path", "digest", "key", "how", "status").unionByName(again).withColumn("batch", F.lit(batch))
        texts = new.select("path", "text").join(placed.select(F.col("id").alias("path"), "key"), "path")
        self.log.commit(batch, {"filed": filed, "works": works, "texts": texts})
        return True

    def filed(self) -> DataFrame:
        return self.log.read("filed")

    def move(self, batch: int, folder: str) -> int:
        """Moves a batch's filed files to ``folder`` as ``key--name``, from the executors; how many were still there."""

        def run(batches):
            import pyarrow as pa
            from pyarrow import fs

            store, root = opened(folder)
            n = 0
            for b in batches:
                for path, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    source, at = opened(path)
                    if source.get_file_info(at).type == fs.FileType.File:
                        store.move(at, f"{root}/{key}--{at.rsplit('/', 1)[-1]}")
                        n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        rows = self.filed().where((F.col("batch") == batch) & F.col("key").isNotNull()).select("path", "key")
        return map_batches(rows, run, "n long").agg(F.sum("n")).first()[0] or 0

    def stream(self, folder: str, checkpoint: str, filed_folder: str | None = None, *, files_a_batch: int = 1000) -> StreamingQuery:
        """Files what lies in ``folder`` and what is dropped there later; with ``filed_folder`` files move on once they are filed."""
        rows = self.spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).schema("value string").load(folder)
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

        def each(batch_rows: DataFrame, batch: int) -> None:
            self.apply(batch, batch_rows)
            if filed_folder:
                self.move(batch, filed_folder)

        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
