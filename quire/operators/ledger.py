"""A ledger of requests to models: what is open, what a failed reply leads to, what it has cost, and what the budget still allows.

A request is known by a digest of its role and texts, so the same request is asked once whoever asks. Attempts come in
batches, in any order and more than once; an attempt counts once, under its number, and only if the request was still
open by then. The ledger is two growing tables of a batch log, so a batch that is applied again changes nothing; a state
is the fold of a request's few attempts and is never stored.

What a reply leads to: a usable one ends the request. An error repeats the full request; an error that is about the
effort option repeats it without one, for nothing. A reply that cannot be used is sent back to be repaired, with low
effort; one that is blank, or was a repair, leads to the full request with a notice. After ``retries`` repeats it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.providers import REQUIRED
from quire.sources.manifests import BatchLog
from quire.sources.shipping import map_batches
from quire.sources.storage import staged

SCHEMAS = {
    "requests": "id string, role string, effort string, prompt string, text string, batch int",
    "attempts": "id string, attempt int, outcome string, model string, cost double",
}
RETRIES = 2
LOW = "low"
#: An error names the effort option and says that it is not known.
UNKNOWN_OPTION = "unknown option|unknown argument|unrecognized|invalid option"


def request_id(role: Column, prompt: Column, text: Column) -> Column:
    """A digest of a request; each part's length keeps texts apart."""
    parts = [F.coalesce(c, F.lit("")) for c in (role, prompt, text)]
    return F.sha2(F.concat_ws("", *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)


def outcomes(replies: DataFrame) -> DataFrame:
    """id, attempt, outcome, model, cost of ``replies`` (id, attempt, role, reply, error, model, cost).

    Outcomes: usable, unusable (no JSON object, or without a key of the role), blank, error, rejected (the effort option).
    """

    def run(batches):
        import pyarrow as pa

        from quire.plans.planning import extract_json

        def outcome(role, reply):
            if not (reply or "").strip():
                return "blank"
            try:
                data = extract_json(reply)
            except ValueError:
                return "unusable"
            return "usable" if all(k in data for k in REQUIRED.get(role, ())) else "unusable"

        for b in batches:
            found = [outcome(role, reply) for role, reply in zip(b.column("role").to_pylist(), b.column("reply").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "attempt", "error", "model", "cost")), pa.array(found, pa.string())], ["id", "attempt", "error", "model", "cost", "read"])

    rows = replies.select("id", F.col("attempt").cast("int").alias("attempt"), "role", "reply", "error", "model", F.col("cost").cast("double").alias("cost"))
    read = map_batches(rows, run, "id string, attempt int, error string, model string, cost double, read string")
    low = F.lower("error")
    said = F.when(low.contains("effort") & low.rlike(UNKNOWN_OPTION), "rejected").when(F.col("error").isNotNull(), "error").otherwise(F.col("read"))
    return read.select("id", "attempt", said.alias("outcome"), "model", "cost")


def folded(attempts: Column, retries: int = RETRIES) -> Column:
    """The state of a request from its attempts (structs of attempt, outcome, cost) in order: state, kind, plain, tries, cost.

    ``kind`` is what is asked next: full, repair or again; ``plain`` says that no effort option may be given. Attempts
    after the end, and after a gap in the numbers, do not count.
    """
    start = F.struct(F.lit("open").alias("state"), F.lit("full").alias("kind"), F.lit(False).alias("plain"), F.lit(0).alias("tries"), F.lit(0).alias("seen"), F.lit(0.0).alias("cost"))

    def step(s: Column, a: Column) -> Column:
        counts = (s["state"] == "open") & (a["attempt"] == s["seen"])
        what = a["outcome"]
        free = (what == "rejected") & ~s["plain"]
        tries = s["tries"] + F.when(free, 0).otherwise(1)
        state = F.when(what == "usable", "done").when(tries > retries, "failed").otherwise("open")
        kind = F.when((what == "unusable") & (s["kind"] != "repair"), "repair").when(what.isin("unusable", "blank"), "again").when(free, s["kind"]).otherwise("full")
        after = F.struct(state.alias("state"), kind.alias("kind"), (s["plain"] | free).alias("plain"), tries.cast("int").alias("tries"), (s["seen"] + 1).alias("seen"), (s["cost"] + F.coalesce(a["cost"], F.lit(0.0))).alias("cost"))
        return F.when(counts, after).otherwise(s)

    return F.aggregate(attempts, start, step)


def running_sum(rows: DataFrame, value: str, order: list[str], name: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to and with each one, in the order of distinct keys.

    Rows are sorted by ranges; each range is summed within itself and gets the total of those before it, one row a range.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.withColumn("_within", within).join(F.broadcast(before), F.col("_range") == F.col("_r"))
    return rows.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_r", "_before", "_within")


class Ledger:
    """Requests and attempts under ``path``."""

    def __init__(self, spark: SparkSession, path: str, *, retries: int = RETRIES):
        self.spark, self.log, self.retries = spark, BatchLog(spark, path, SCHEMAS), retries

    def apply(self, batch: int, requests: DataFrame | None = None, attempts: DataFrame | None = None) -> bool:
        """Takes in requests (role, effort, prompt, text) and attempts (id, attempt, outcome, model, cost); false if the batch was applied before."""
        if self.log.applied(batch):
            return False
        added = {}
        if requests is not None:
            new = requests.select(request_id(F.col("role"), F.col("prompt"), F.col("text")).alias("id"), "role", "effort", "prompt", "text").dropDuplicates(["id"])
            added["requests"] = new.join(self.log.read("requests").select("id"), "id", "left_anti").withColumn("batch", F.lit(batch))
        if attempts is not None:
            # The first that is seen under a number counts; within a batch the least, so that the order of rows does not matter.
            new = attempts.where("id is not null and attempt is not null").groupBy("id", F.col("attempt").cast("int").alias("attempt")).agg(F.min(F.struct("outcome", "model", F.col("cost").cast("double").alias("cost"))).alias("a")).select("id", "attempt", "a.*")
            added["attempts"] = new.join(self.log.read("attempts").select("id", "attempt"), ["id", "attempt"], "left_anti")
        self.log.commit(batch, added)
        return True

    def stream(self, replies: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in every micro-batch of a stream of replies, as ``outcomes`` reads them."""
        return replies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.apply(batch, attempts=outcomes(rows))).start()

    def states(self) -> DataFrame:
        """id, role, state, kind, effort (of the next attempt), tries, next_attempt, cost of every request."""
        told = self.log.read("attempts").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("attempt", "outcome", "cost"))).alias("a"))
        none = F.array().cast("array<struct<attempt:int,outcome:string,cost:double>>")
        rows = self.log.read("requests").drop("prompt", "text").join(told, "id", "left").withColumn("s", folded(F.coalesce("a", none), self.retries))
        effort = F.when(F.col("s.plain"), F.lit(None)).when(F.col("s.kind") == "repair", LOW).otherwise(F.col("effort"))
        return rows.select("id", "role", "batch", F.col("s.state").alias("state"), F.col("s.kind").alias("kind"), effort.alias("effort"), F.col("s.tries").alias("tries"), F.col("s.seen").alias("next_attempt"), F.col("s.cost").alias("cost"))

    def usage(self) -> DataFrame:
        """model, calls, cost over all attempts."""
        return self.log.read("attempts").groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))

    def due(self, budget: float, estimate: float) -> DataFrame:
        """Open requests with ``allowed``: the oldest first, as long as what was spent and ``estimate`` for each fits the budget."""
        states = staged(self.states(), "ledger")
        spent = states.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        waiting = running_sum(states.where("state = 'open'").withColumn("_estimate", F.lit(float(estimate))), "_estimate", ["batch", "id"])
        return waiting.withColumn("allowed", F.col("running") <= budget - spent).drop("_estimate", "running")
