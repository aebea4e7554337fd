"""Numbered manifests: what is alive in a folder of tables, committed by a rename that fails where another writer was faster."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


class ManifestConflict(RuntimeError):
    """Another writer committed first; the batch has to be applied again."""


class Folder:
    """Small files of a folder through Hadoop's file system, which also knows how to refuse an existing name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.folder.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def names(self) -> list[str]:
        """Names in order, without those that begin with a full stop."""
        if not self.fs.exists(self.folder):
            return []
        return sorted(n for f in self.fs.listStatus(self.folder) if not (n := f.getPath().getName()).startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a whole file under a name of its own; false if the name is taken."""
        temporary, final = self._path(f".{name}.{uuid.uuid4().hex}"), self._path(name)
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        never_over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(temporary), self.fs.makeQualified(final), never_over)
        except Exception as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Manifests:
    """The manifests under ``path``/manifests; the last one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder, self.path = Folder(spark, f"{path}/manifests"), path

    def latest(self) -> tuple[int, dict | None]:
        """(number, content); 0 and null before the first."""
        names = self.folder.names()
        return (int(names[-1].split(".")[0]), json.loads(self.folder.read(names[-1]))) if names else (0, None)

    def commit(self, number: int, content: dict) -> None:
        if not self.folder.create(f"{number:012d}.json", json.dumps(content)):
            raise ManifestConflict(f"manifest {number} of {self.path} was committed by another writer")

    def prune(self, keep: int = 1) -> list[dict]:
        """Deletes all but the last ``keep``; the content of those."""
        names = self.folder.names()
        for n in names[:-keep]:
            self.folder.delete(n)
        return [json.loads(self.folder.read(n)) for n in names[-keep:]]


class BatchLog:
    """Tables that grow by batches, each applied once: a batch whose number was committed before changes nothing.

    A batch's parts of every table are written first, then the manifest names them. Many small parts become one.
    """

    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self.manifests = Manifests(spark, self.path)

    def state(self) -> tuple[int, dict]:
        number, content = self.manifests.latest()
        return number, content or {"last_batch": -1, "parts": {t: [] for t in self.schemas}}

    def applied(self, batch: int) -> bool:
        return batch <= self.state()[1]["last_batch"]

    def read(self, table: str) -> DataFrame:
        parts = self.state()[1]["parts"][table]
        if not parts:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.path}/{table}/{p}" for p in parts])

    def commit(self, batch: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> None:
        """Commits a batch's new rows; tables in ``replaced`` are held whole by theirs."""
        number, content = self.state()
        parts = {t: list(p) for t, p in content["parts"].items()}
        for table, rows in (added | (replaced or {})).items():
            name = uuid.uuid4().hex
            columns = StructType(_parse_datatype_string(self.schemas[table]).fields).names
            if table in added and len(parts[table]) >= self.MOST_PARTS:
                rows = self.read(table).unionByName(rows.select(*columns))
                parts[table] = []
            rows.select(*columns).write.parquet(f"{self.path}/{table}/{name}")
            parts[table] = [*([] if table in (replaced or {}) else parts[table]), name]
        self.manifests.commit(number + 1, {"last_batch": batch, "parts": parts})
