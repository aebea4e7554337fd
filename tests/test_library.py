"""Entry files, the library on disk and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.library import Library, libraries, resolve
from quire.sources import entryfiles
from quire.streaming import events


@pytest.fixture
def library(spark, tmp_path, stocked):
    lib = Library.create(spark, str(tmp_path), "My Lib", "transformers")
    lib.save(stocked)
    return lib


from tests.test_operators import stocked  # noqa: E402, F401


def test_round_trip(spark, library):
    assert library.keys() == ["a2017", "b2020", "c2010"] and len(library) == 3 and library.has("a2017") and not library.has("x")
    b = library.get("b2020").first()
    assert b["notes"] == "mine" and b["references"][0]["arxiv_id"] == "1706.03762" and b["tags"] == ["LLM"] and b["year"] == 2020 and b["added"]
    library.save(library.entries().drop("path", "mtime").withColumn("notes", F.lit("overwritten")))
    assert library.get("b2020").first()["notes"] == "mine"
    assert library.set_notes("b2020", "more", append=True) and library.get("b2020").first()["notes"] == "mine\n\nmore"


def test_index_follows_files(spark, library):
    assert library.sync() == 3 and library.sync() == 0
    library.delete("c2010")
    assert library.sync() == 1 and [r["key"] for r in library.search("few-shot").collect()] == ["b2020"]
    with pytest.raises(ValueError):
        library.delete("a2017", "nope")
    assert library.has("a2017")


def test_corrupt_files_are_set_aside(spark, library, tmp_path):
    (tmp_path / "my-lib/entries/bad.md").write_text("no front matter")
    assert [r["stem"] for r in library.corrupt().collect()] == ["bad"] and library.entries().count() == 3 and len(library) == 4


def test_body_of_foreign_files(spark, tmp_path):
    (tmp_path / "x.md").write_text('---\nkey: "x"\ntitle: "T"\nyear: "2001"\n---\n\n## One-line summary\n\nOne.\n\n## Key findings\n\n- a\n* b\nc\n\n## Detailed summary\n\n### M\n\nbody\n\n### R\n\nres\n\n' + entryfiles.NOTES_BANNER + "\n\n## Notes\n\nhello\n")
    r = entryfiles.read_entries(spark, str(tmp_path)).first()
    assert (r["year"], r["one_liner"], r["key_findings"], r["notes"]) == (2001, "One.", ["a", "b"], "hello") and [(s["name"], s["summary"]) for s in r["sections"]] == [("M", "body"), ("R", "res")]


def test_exchange(spark, library, tmp_path):
    assert library.export(str(tmp_path / "bundle"), ["a2017"]) == 1 and library.peek(str(tmp_path / "bundle"))["entries"] == 1
    other = Library.create(spark, str(tmp_path), "other")
    assert [r["outcome"] for r in other.import_bundle(str(tmp_path / "bundle")).collect()] == ["added"] and other.keys() == ["a2017"]
    assert [r["outcome"] for r in other.import_bundle(str(tmp_path / "bundle"), "skip").collect()] == ["skipped"]
    assert libraries(spark, str(tmp_path)) == ["my-lib", "other"] and resolve(spark, str(tmp_path), "other").settings.name == "other"
    with pytest.raises(ValueError):
        resolve(spark, str(tmp_path))
    assert library.unique_key("a2017") == "a2017a"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:00:10"), (2, "a", 2.0, "2024-01-01 00:09:00"), (1, "b", 3.0, "2024-01-01 00:50:00")], "user_id int, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream, "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select event_type, n, total from windows").collect())) == sorted(map(tuple, events.windowed_counts(rows, "10 minutes").select("event_type", "n", "total").collect()))
    changes = spark.createDataFrame([("k1", "insert", 1), ("k2", "insert", 2)], "key string, change string, v int")
    changes.write.parquet(str(tmp_path / "c"))
    q = events.sync_index(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "c")), str(tmp_path / "index"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index/v0")).count() == 2


def test_commands(spark, library, tmp_path, capsys):
    from quire import cli

    run = lambda *a: (cli.main(["--root", str(tmp_path), "--json", *a]), capsys.readouterr())
    assert run("libs")[1].out.split() == ["my-lib"]
    code, out = run("ls", "--level", "A*")
    assert code == 0 and [x.split('"key":"')[1][:5] for x in out.out.splitlines()] == ["b2020", "a2017"]
    assert run("note", "nope", "x")[0] == 1 and run("note", "a2017", "x")[0] == 0
    assert run("delete", "nope")[0] == 1 and '"linked":1' in run("links")[1].out
