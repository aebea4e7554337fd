"""Claims traced back to their origin, as walks that wait for readings and go on when these come.

A walk stands at a work. It needs the work's reading for the claim (an answer: does it state the claim, is it the origin,
which of its references does it blame), then the readings of up to three blamed references, of which it takes an origin
first, else the oldest that states the claim. Answers come in batches, in any order; some never come. All walks advance
together, a step of one is a few joins, and a step depends on the work only, so walks that meet share it and its requests.

Everything is a table of a batch log: answers (the first for a claim and work counts), the front of open walks, hops, and
finished walks with what ended them. A batch that is applied again changes nothing, so ``stream`` is exactly once.

Ends: origin; unattributed (blames nothing traceable) and unconfirmed (none of the blamed works can be read or states the
claim), where the last work counts as origin; failed, unreadable, looped, stopped (too many hops), unresolved (no such
work). A walk without an end is ``walking``. Null ids match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.citations import MAX_HOPS, next_references
from quire.plans.providers import contract
from quire.sources.manifests import BatchLog
from quire.sources.storage import staged

SCHEMAS = {
    "answers": "claim string, node string, states_claim boolean, is_origin boolean, failed boolean, attributed array<struct<index:int,confidence:double>>",
    "front": "claim string, start string, hop int, node string, seen array<string>, entered boolean",
    "hops": "claim string, start string, hop int, node string, states_claim boolean, is_origin boolean",
    "done": "claim string, start string, hop int, status string",
}
#: Ends at which the last work is the earliest source that could be reached.
EARLIEST = ("unattributed", "unconfirmed")
#: Works are joined as the planner likes up to so many; beyond it nothing goes through the driver to be broadcast.
BROADCAST_ROWS = 200_000
#: Fields of a reading's reply.
FIELDS = {"states_claim": "whether the work states the claim", "is_origin": "whether the claim is first made here", "evidence_quote": "the sentence", "attributed_to": "a list of {index, confidence}: references that the claim is credited to"}


def _known(answers: DataFrame, node: str, prefix: str) -> DataFrame:
    kept = ["states_claim", "is_origin", "failed"] + (["attributed"] if node == "node" else [])
    return answers.select("claim", F.col("node").alias(node), F.lit(True).alias(f"{prefix}here"), *[F.col(c).alias(prefix + c) for c in kept])


class ClaimWalks:
    """Walks under ``path``; ``works`` has node, year, readable, and ``references`` node, index, cited, title, doi, arxiv_id."""

    def __init__(self, spark: SparkSession, path: str, works: DataFrame, references: DataFrame, *, max_hops: int = MAX_HOPS):
        self.spark, self.log, self.max_hops = spark, BatchLog(spark, path, SCHEMAS), max_hops
        # Every step reads both, so they are computed once.
        self.works = staged(works.select("node", "year", F.coalesce("readable", F.lit(False)).alias("readable")), "claim-works")
        self.references = staged(references.select("node", "index", "cited", "title", "doi", "arxiv_id"), "claim-references")
        self._many = self.works.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS

    def _met(self, rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
        """A join whose other side grows with the works: by a shuffle where these are many, as a small file may hold many rows."""
        return rows.hint("merge").join(other.hint("merge"), on, how) if self._many else rows.join(other, on, how)

    def begin(self, starts: DataFrame) -> None:
        """Opens a walk for every new (claim, node)."""
        new = starts.select("claim", F.col("node").alias("start")).where("start is not null").distinct()
        there = self.log.read("front").select("claim", "start").unionByName(self.log.read("done").select("claim", "start"))
        new = self._met(new, there, ["claim", "start"], "left_anti").select("claim", "start", F.lit(0).alias("hop"), F.col("start").alias("node"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("entered"))
        self.log.commit(self.log.state()[1]["last_batch"], {}, {"front": self.log.read("front").unionByName(new)})

    # -- a step ----------------------------------------------------------------------------------------------

    def _candidates(self, at: DataFrame, answers: DataFrame) -> DataFrame:
        """claim, node, cited, place, readable, year and the reading (c_...) of what each (claim, node, attributed) blames."""
        blamed = at.select("claim", "node", F.explode("attributed").alias("a")).select("claim", F.col("node").alias("citing"), "a.index", "a.confidence")
        refs = self.references.select(F.col("node").alias("citing"), "index", "cited", "title", "doi", "arxiv_id")
        rows = self._met(blamed, refs, ["citing", "index"]).select(F.struct("claim", "citing").alias("node"), F.col("index").alias("ord"), "confidence", "title", "doi", "arxiv_id", "cited")
        picks = next_references(rows).select("node.claim", F.col("node.citing").alias("node"), "cited", "place")
        works = self.works.select(F.col("node").alias("cited"), "year", F.col("readable").alias("c_readable"))
        return self._met(self._met(picks, works, "cited", "left"), _known(answers, "cited", "c_"), ["claim", "cited"], "left")

    def _forks(self, at: DataFrame, answers: DataFrame) -> DataFrame:
        """claim, node, waiting, best of the works that walks stand at."""
        can = self._candidates(at, answers)
        states = F.col("c_readable") & ~F.coalesce("c_failed", F.lit(False)) & F.coalesce("c_states_claim", F.lit(False))
        rank = F.struct((~F.coalesce("c_is_origin", F.lit(False))).alias("no"), F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)).alias("year"), "place", "cited")
        return can.groupBy("claim", "node").agg(F.sum((F.coalesce("c_readable", F.lit(False)) & F.col("c_here").isNull()).cast("int")).alias("waiting"), F.min(F.when(states, rank)).alias("best"))

    def _readings(self, front: DataFrame, answers: DataFrame) -> DataFrame:
        """claim, node, the reading, waiting and best of every answered work of a claim with open walks: all that a step needs, computed once a batch."""
        own = answers.join(front.select("claim").distinct(), "claim", "left_semi")
        at = own.select("claim", "node", "attributed")
        read = _known(own, "node", "a_").drop("a_attributed")
        return staged(self._met(read, self._forks(at, answers), ["claim", "node"], "left"), "claim-readings")

    def _step(self, front: DataFrame, readings: DataFrame) -> DataFrame:
        """Every open walk after one step, with the hop that it made and how it ended."""
        works = self.works.select("node", "readable")
        rows = self._met(self._met(front, works, "node", "left"), readings, ["claim", "node"], "left")
        entering = ~F.col("entered")
        end = (
            F.when(F.col("hop") >= self.max_hops, "stopped").when(F.array_contains("seen", F.col("node")), "looped").when(F.col("readable").isNull() & (F.col("hop") == 0), "unresolved")
            .when(~F.coalesce("readable", F.lit(False)), "unreadable").when(F.col("a_here").isNull(), "waiting").when(F.col("a_failed"), "failed").when(F.col("a_is_origin"), "origin")
        )
        rows = rows.withColumn("end", F.when(entering, end))
        rows = rows.withColumn("made", entering & (F.col("end").isNull() | F.col("end").isin("unreadable", "failed", "origin")))
        choosing = F.col("end").isNull()
        status = F.when(choosing & F.col("waiting").isNull(), "unattributed").when(choosing & (F.col("waiting") == 0) & F.col("best").isNull(), "unconfirmed").when(F.col("end") != "waiting", F.col("end"))
        moves = choosing & (F.col("waiting") == 0) & F.col("best").isNotNull()
        said = lambda c: F.coalesce(F.when(~F.coalesce("a_failed", F.lit(False)) & F.col("readable"), F.col(c)), F.lit(False))
        return rows.select(
            "claim", "start", (F.col("hop") + F.col("made").cast("int")).alias("hop"), F.col("node").alias("was"), "made", status.alias("status"), said("a_states_claim").alias("states_claim"), said("a_is_origin").alias("is_origin"),
            F.when(moves, F.col("best.cited")).otherwise(F.col("node")).alias("node"), F.when(moves, F.concat("seen", F.array("node"))).otherwise(F.col("seen")).alias("seen"),
            ((F.col("entered") | F.col("made")) & ~moves).alias("entered"), (F.col("made") | moves | status.isNotNull()).alias("moved"),
        )

    # -- batches ---------------------------------------------------------------------------------------------

    def advance(self, batch: int, answers: DataFrame) -> bool:
        """Takes in a batch of answers and lets all walks go as far as they can; false if the batch was applied before."""
        if self.log.applied(batch):
            return False
        names = ["states_claim", "is_origin", "failed", "attributed"]
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in names[:3]]
        once = answers.select("claim", "node", *flags, "attributed").groupBy("claim", "node").agg(F.min(F.struct(*names)).alias("a")).select("claim", "node", "a.*")
        known = self.log.read("answers")
        new = staged(self._met(once, known, ["claim", "node"], "left_anti"), "claim-answers")
        front, hops, done = self.log.read("front"), [], []
        readings = self._readings(front, known.unionByName(new))
        while True:
            step = staged(self._step(front, readings), "claim-step")
            hops.append(step.where("made").select("claim", "start", "hop", F.col("was").alias("node"), "states_claim", "is_origin"))
            done.append(step.where("status is not null").select("claim", "start", "hop", "status"))
            front = step.where("status is null").select("claim", "start", "hop", "node", "seen", "entered")
            if step.where("moved and status is null").isEmpty():
                break
        whole = lambda parts: parts[0] if len(parts) == 1 else whole([parts[0].unionByName(parts[1]), *parts[2:]])
        self.log.commit(batch, {"answers": new, "hops": whole(hops), "done": whole(done)}, {"front": front})
        return True

    def stream(self, answers: DataFrame, checkpoint: str) -> StreamingQuery:
        """Advances by every micro-batch of a stream of answers."""
        return answers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.advance(batch, rows)).start()

    # -- results ---------------------------------------------------------------------------------------------

    def hops(self) -> DataFrame:
        """claim, start, hop, node, states_claim, is_origin, status of every hop so far."""
        ends = self.log.read("done").select("claim", "start", F.col("hop").alias("_last"), "status")
        rows = self._met(self.log.read("hops"), ends, ["claim", "start"], "left")
        earliest = F.col("status").isin(*EARLIEST) & (F.col("hop") == F.col("_last"))
        return rows.withColumns({"is_origin": F.col("is_origin") | F.coalesce(earliest, F.lit(False)), "status": F.coalesce("status", F.lit("walking"))}).drop("_last")

    def pending(self) -> DataFrame:
        """claim, node of the readings that open walks wait for, each once."""
        front, answers = self.log.read("front"), self.log.read("answers")
        rows = self._met(front, _known(answers, "node", "a_"), ["claim", "node"], "left")
        own = rows.where("a_here is null").select("claim", "node")
        at = rows.where("entered and a_here").select("claim", "node", F.col("a_attributed").alias("attributed")).dropDuplicates(["claim", "node"])
        blamed = self._candidates(at, answers).where("c_readable and c_here is null").select("claim", F.col("cited").alias("node"))
        return own.unionByName(blamed).distinct()


def request_texts(pending: DataFrame, claims: DataFrame, works: DataFrame, references: DataFrame) -> DataFrame:
    """claim, node, request, text: what a reader is asked, with the numbered references and the work's text.

    ``claims`` has claim, wording; ``works`` node, title, text; a node's references come in one row.
    """
    listed = references.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("index", "title"))).alias("refs"))
    lines = F.array_join(F.transform(F.coalesce("refs", F.array().cast("array<struct<index:int,title:string>>")), lambda r: F.concat(F.lit("["), r["index"].cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("")))), "\n")
    rows = pending.join(claims, "claim").join(works.select("node", "title", "text"), "node").join(listed, "node", "left")
    text = F.concat(F.lit(contract("origin", FIELDS) + "\nclaim: "), "wording", F.lit("\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\nreferences:\n"), lines)
    return rows.select("claim", "node", text.alias("request"), "text")


def found_starts(claims: DataFrame, hits: DataFrame, works: DataFrame, scouted: DataFrame, limit: int = 3) -> DataFrame:
    """claim, node, origin: a readable work that may state the claim, from the best verified library hits, else from what a scout named.

    ``hits`` has claim, node, rank, verified; ``scouted`` claim, node, ord. Claims without any are left out.
    """
    readable = works.where("readable").select("node")
    mine = hits.where(F.col("verified") & (F.col("rank") <= limit)).select("claim", "node", F.lit(0).alias("way"), F.col("rank").alias("at"))
    theirs = scouted.where(F.col("ord") < limit).select("claim", "node", F.lit(1).alias("way"), F.col("ord").alias("at"))
    rows = mine.unionByName(theirs).join(readable, "node", "left_semi").join(claims.select("claim"), "claim", "left_semi")
    return rows.groupBy("claim").agg(F.min_by("node", F.struct("way", "at", "node")).alias("node"), F.min("way").alias("_way")).select("claim", "node", F.when(F.col("_way") == 0, "library").otherwise("scout").alias("origin"))


def to_adopt(hops: DataFrame, works: DataFrame, entries: DataFrame) -> DataFrame:
    """The walked works that state a claim and that no entry is (by ``entries.node``): once each, to be added."""
    wanted = hops.where("states_claim").select("node").distinct()
    return works.join(wanted, "node", "left_semi").join(entries.select("node"), "node", "left_anti")


def chain_titles(hops: DataFrame, works: DataFrame) -> DataFrame:
    """claim, start, chain: 'Title (year) -> Title (year, original)'."""
    from quire.functions.documents import short

    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("n.d."))
    label: Column = F.concat(short(F.col("title")), F.lit(" ("), year, F.when(F.col("is_origin"), ", original").otherwise(""), F.lit(")"))
    rows = hops.join(works.select("node", "title", "year"), "node", "left").select("claim", "start", F.struct("hop", label.alias("label")).alias("h"))
    return rows.groupBy("claim", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["label"]), " -> ").alias("chain"))
