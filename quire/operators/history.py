"""What was known when: as-of joins and the state of a library at a time.

An as-of join sorts both sides together by ranges of (key, time) and carries the last change forward. Within a range that
is a window; a key that spans ranges gets one more row for each of them, which brings the change that held before. So a key
with a third of all rows is cut into many tasks, and no side is shuffled a second time by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.storage import staged


def as_of(rows: DataFrame, changes: DataFrame, *, key: str = "key", at: str = "at") -> DataFrame:
    """``rows`` with the other columns of the last change of their key at or before their time; nulls where there is none.

    Of changes at one time the greatest counts, by their columns in order. Null keys and times match nothing. Columns of
    ``changes`` that ``rows`` has too are refused by name.
    """
    values = [c for c in changes.columns if c not in (key, at)]
    if clash := set(values) & set(rows.columns):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    change = F.struct(*[F.col(c) for c in values])
    ours = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_row")).withColumn("_change", F.lit(None).cast(changes.select(change.alias("c")).schema["c"].dataType))
    theirs = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), change.alias("_change"))
    theirs = theirs.groupBy("_key", "_at").agg(F.max("_change").alias("_change")).select("_key", "_at", F.lit(0).alias("_kind"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), "_change")
    both = theirs.unionByName(ours).repartitionByRange("_key", "_at", "_kind").withColumn("_range", F.spark_partition_id())
    both = staged(both, "as-of")
    within = Window.partitionBy("_range", "_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_held", F.last("_change", ignorenulls=True).over(within)).where("_kind = 1")
    ends = both.groupBy("_key", "_range").agg(F.max_by("_change", F.when(F.col("_change").isNotNull(), F.col("_at"))).alias("_end"))
    # One row for each range that a key is in; keys within one range need nothing from before.
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null and _key is not null").select("_key", "_range", "_carried")
    out = held.join(carried, ["_key", "_range"], "left")
    known = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_held", "_carried"))
    return out.withColumn("_known", known).select("_row.*", *[F.col("_known").getField(c).alias(c) for c in values])


def state_at(changes: DataFrame, at, *, key: str = "key", field: str = "field", value: str = "value", time: str = "at") -> DataFrame:
    """key, field, value of the last change of each field at or before a time; a null value means that the field was emptied."""
    last = changes.where(F.col(time) <= F.lit(at)).groupBy(key, field).agg(F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("l"))
    return last.select(key, field, F.col("l.v").alias(value))
