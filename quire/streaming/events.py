"""Windows, sessions, duplicates and index sync over streams; the same functions work on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "1 hour"


def _marked(rows: DataFrame, at: str) -> DataFrame:
    return rows.withWatermark(at, WATERMARK) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, size: str, *, at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """start, ``by``, n and total of each tumbling window; late rows count until the watermark has passed."""
    rows = _marked(events.withColumn(at, F.col(at).cast("timestamp")), at)
    return rows.groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, *, at: str = "ts", by: str = "user_id") -> DataFrame:
    """``by``, start, end and n of runs of events with less than ``gap`` between them."""
    rows = _marked(events.withColumn(at, F.col(at).cast("timestamp")), at)
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: list[str], *, at: str = "ts") -> DataFrame:
    """Each key once; a stream forgets keys once the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def sync_index(changes: DataFrame, path: str, checkpoint: str, *, key: str = "key"):
    """Keeps a Parquet table at ``path`` up to date from a stream of (key, change, ...) rows; the running query.

    Each batch writes a new version beside the old ones and then names it in ``current``, so readers never see half a
    version and a repeated batch writes the same one again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        previous = f"{path}/v{number - 1}"
        live = batch.where("change <> 'delete'").drop("change").dropDuplicates([key])
        if number:
            live = spark.read.parquet(previous).join(batch.select(key).distinct(), key, "left_anti").unionByName(live)
        live.write.mode("overwrite").parquet(f"{path}/v{number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").json(f"{path}/current")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
