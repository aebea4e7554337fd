"""The answers of bibliographic indexes as a Spark data source: ``spark.read.format("quire_index")``.

A folder of recorded answers holds a file for each page that a host was asked for, ``host~year~page.json``. The options
``hosts``, ``year_from`` and ``year_to`` decide which pages are asked for at all, as the window of a search does at the
index itself. They are options and no pushed filters: Spark 4.1 keeps what one query pushed into a loaded Python source
for the next query of the same DataFrame, which would then miss rows. A host's pages have an order, and ``asked_at`` is
when a client that keeps the host's spacing would ask for each: so pages of one host can be read in many tasks, and the
schedule is the same however they are cut.

Further options: ``folder``, ``spacing`` (JSON: host to seconds, else the hosts' own), ``pages_per_task``. The module is
sent to the workers whole, so it imports nothing of this package.
"""

from __future__ import annotations

import dataclasses
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "host string, year int, page int, asked_at double, payload string"
PAGES_PER_TASK = 200


def _opened(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


@dataclasses.dataclass
class Pages(InputPartition):
    """Pages of one host that follow each other: names, years, numbers and when each is asked for."""

    host: str
    pages: list[tuple[str, int, int, float]]


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["folder"]
        self.spacing = {k: float(v) for k, v in json.loads(options.get("spacing", "{}")).items()}
        self.per_task = int(options.get("pages_per_task", PAGES_PER_TASK))
        self.hosts = set(json.loads(options.get("hosts", "[]")))
        self.first, self.last = int(options.get("year_from", 0)), int(options.get("year_to", 9999))

    def _asked(self, host: str, year: int) -> bool:
        return (not self.hosts or host in self.hosts) and self.first <= year <= self.last

    def partitions(self) -> list[Pages]:
        from pyarrow import fs

        store, root = _opened(self.folder)
        by_host: dict[str, list[tuple[int, int, str]]] = {}
        for f in store.get_file_info(fs.FileSelector(root)):
            parts = f.base_name.removesuffix(".json").split("~")
            if len(parts) == 3 and parts[1].isdigit() and parts[2].isdigit():
                if self._asked(parts[0], int(parts[1])):
                    by_host.setdefault(parts[0], []).append((int(parts[1]), int(parts[2]), f.base_name))
        out = []
        for host, pages in sorted(by_host.items()):
            timed = [(name, year, page, i * self.spacing.get(host, 0.0)) for i, (year, page, name) in enumerate(sorted(pages))]
            out += [Pages(host, timed[at : at + self.per_task]) for at in range(0, len(timed), self.per_task)]
        return out or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, root = _opened(self.folder)
        for name, year, page, at in partition.pages:
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                yield partition.host, year, page, at, f.read().decode("utf-8", "replace")


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)


def recorded(spark: SparkSession, folder: str, spacing: dict[str, float] | None = None, *, hosts: tuple[str, ...] = (), year_from: int = 0, year_to: int = 9999, pages_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """host, year, page, asked_at, payload of the recorded answers of some hosts (default: all) and years, in a folder that all executors see."""
    from quire.sources.http import SPACING

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(IndexSource)
    options = {"folder": folder, "hosts": json.dumps(hosts), "year_from": str(year_from), "year_to": str(year_to), "spacing": json.dumps(SPACING if spacing is None else spacing), "pages_per_task": str(pages_per_task)}
    return spark.read.format("quire_index").options(**options).load()


def record(answers: DataFrame, folder: str) -> int:
    """Writes answers (host, year, page, payload) as such a folder; how many pages."""
    from pyspark.sql import functions as F

    from quire.sources.files import write_texts

    return write_texts(answers.select(F.concat_ws("~", "host", F.col("year").cast("string"), F.col("page").cast("string")).alias("_n"), "payload").select(F.concat("_n", F.lit(".json")).alias("name"), F.col("payload").alias("text")), folder)
