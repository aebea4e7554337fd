"""Repair of conversation structure at least cost by lazy weighted determinisation.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Every row may be kept (0), given the role user or
assistant (3) or deleted (4; the only choice for blank and repeated rows), an empty user or assistant row may be inserted
anywhere (3), and a truncated row that is not deleted adds 3.

The cheapest costs of reaching the grammar's states are a vector. Less its minimum, and without entries that another
state beats whatever follows, only some hundred vectors occur: they are the states of an automaton that is built as rows ask for
it, so a scan is one table lookup a row and gives the cost. From the end, arcs that cost what their vectors differ by
(tight arcs) tell which states lie on a cheapest path; reading on along these, the ASCII-least letter first, gives the
audit. All three steps are cached by table entry.

At scale: rows become one byte each (role and fault) in Spark, sorted by ranges, so a long conversation is cut into many
tasks until its bytes are joined; that string has as many bytes as the audit has letters, and is all that a conversation
brings into one row. Repeated rows are found by a partial aggregation. The repaired text streams through sorted
partitions; the hash of a conversation is a chain over its text, so that one pass is a single task's, in bounded memory.

Defined results: null texts and roles are one space; a null ``conv_id`` is a conversation of its own; rows come by turn,
null turns first, rows of one turn in the order of a digest of role and text (so repeated rows are neighbours);
conversations without rows have zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other
columns play no part and may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, staged

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The grammar's states: nothing yet, after the system row, after a user's, after an assistant's.
START, OPENED, ASKED, ANSWERED = range(4)
MOVES = {(START, SYSTEM): OPENED, (START, USER): ASKED, (OPENED, USER): ASKED, (ASKED, ASSISTANT): ANSWERED, (ANSWERED, USER): ASKED}
FINAL = (START, ANSWERED)
#: From ANSWERED any rest of a conversation costs at most so much more than from another state: a system row is deleted, or a user row inserted.
ADVANTAGE = max(DELETE_COST, INSERT_COST)
INSERTS = [(q, to) for (q, role), to in MOVES.items() if role in (USER, ASSISTANT)]
FAR = 1 << 40
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of a conversation that a task packs into one string.
PACKED = 1 << 16


@functools.cache
def row_arcs(symbol: int) -> dict[str, list[tuple[int, int, int]]]:
    """letter -> (state, next state, cost) of a row; ``symbol`` is 4 * fault + role."""
    fault, role = divmod(symbol, 4)
    arcs = {"D": [(q, q, DELETE_COST) for q in range(4)], "K": [], "R": []}
    if fault in (SOUND, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        arcs["K"] = [(q, to, KEEP_COST + more) for (q, r), to in MOVES.items() if r == role]
        arcs["R"] = [(q, to, REROLE_COST + more) for q, to in INSERTS]
    return arcs


class Repairs:
    """The automaton, built lazily; vectors are numbered as they are met."""

    def __init__(self):
        self.vectors, self.number, self.table = [], {}, {}
        self.first = self._number(self._settled([0, FAR, FAR, FAR])[0])
        self._masks, self._steps = {}, {}

    def _number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def _settled(costs: list[int]) -> tuple[tuple[int, ...], int]:
        """(normalised vector, its minimum) after insertions, without entries that cannot be on a cheapest path."""
        for _ in range(3):
            for q, to in INSERTS:
                costs[to] = min(costs[to], costs[q] + INSERT_COST)
        costs = [c if c <= costs[ANSWERED] + ADVANTAGE else FAR for c in costs]
        least = min(costs)
        return tuple(c - least if c < FAR else FAR for c in costs), least

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, what the minimum grew by)."""
        found = self.table.get((state, symbol))
        if found is None:
            before, costs = self.vectors[state], [FAR] * 4
            for arcs in row_arcs(symbol).values():
                for q, to, cost in arcs:
                    if before[q] < FAR:
                        costs[to] = min(costs[to], before[q] + cost)
            vector, grown = self._settled(costs)
            found = self.table[state, symbol] = (self._number(vector), grown)
        return found

    def scan(self, symbols: bytes) -> tuple[array, int]:
        """(states before each row and at the end, least cost)."""
        state, cost, states = self.first, 0, array("H", [self.first])
        for s in symbols:
            state, grown = self.move(state, s)
            cost += grown
            states.append(state)
        return states, cost + min(self.vectors[state][q] for q in FINAL)

    def _with_inserts(self, state: int, useful: set[int]) -> frozenset[int]:
        v = self.vectors[state]
        for _ in range(3):
            useful |= {q for q, to in INSERTS if to in useful and v[q] < FAR and v[q] + INSERT_COST == v[to]}
        return frozenset(useful)

    def last(self, state: int) -> tuple[frozenset[int], frozenset[int]]:
        """(best final states, all from which tight insertions lead there) at the end."""
        v = self.vectors[state]
        best = frozenset(q for q in FINAL if v[q] == min(v[f] for f in FINAL))
        return best, self._with_inserts(state, set(best))

    def _tight(self, state: int, symbol: int, letter: str, after: frozenset[int]) -> list[tuple[int, int]]:
        (to_state, grown), before = self.move(state, symbol), self.vectors[state]
        target = self.vectors[to_state]
        return [(q, to) for q, to, cost in row_arcs(symbol)[letter] if to in after and before[q] < FAR and before[q] + cost == target[to] + grown]

    def useful(self, state: int, symbol: int, after: frozenset[int]) -> frozenset[int]:
        """States before a row that lie on a cheapest path, given those after it."""
        key = state, symbol, after
        if key not in self._masks:
            self._masks[key] = self._with_inserts(state, {q for letter in "DKR" for q, _ in self._tight(state, symbol, letter, after)})
        return self._masks[key]

    def _inserted(self, state: int, at: frozenset[int], within: frozenset[int]) -> frozenset[int]:
        v = self.vectors[state]
        return frozenset(to for q, to in INSERTS if q in at and to in within and v[q] + INSERT_COST == v[to])

    def step(self, state: int, symbol: int, after: frozenset[int], at: frozenset[int]) -> tuple[str, frozenset[int]]:
        """(least letters up to and with a row's, states reached) from the states ``at``."""
        key = state, symbol, after, at
        if key not in self._steps:
            here, letters = self.useful(state, symbol, after), ""
            while True:
                moves = {letter: frozenset(to for q, to in self._tight(state, symbol, letter, after) if q in at) for letter in "DKR"}
                if not moves["D"] and (on := self._inserted(state, at, here)):
                    letters, at = letters + "I", on
                    continue
                letter = next(x for x in "DKR" if moves[x])
                self._steps[key] = letters + letter, moves[letter]
                break
        return self._steps[key]

    def repaired(self, symbols: bytes) -> tuple[int, str]:
        """(least cost, ASCII-least audit) of a conversation."""
        states, cost = self.scan(symbols)
        best, mask = self.last(states[-1])
        kinds: list[frozenset[int]] = []
        kind_of: dict[frozenset[int], int] = {}
        masks = array("H", bytes(2 * (len(symbols) + 1)))
        for i in range(len(symbols), -1, -1):
            if i < len(symbols):
                mask = self.useful(states[i], symbols[i], mask)
            if mask not in kind_of:
                kind_of[mask] = len(kinds)
                kinds.append(mask)
            masks[i] = kind_of[mask]
        at, letters = frozenset([START]), []
        for i, s in enumerate(symbols):
            found, at = self.step(states[i], s, kinds[masks[i + 1]], at)
            letters.append(found)
        while not at & best:
            letters.append("I")
            at = self._inserted(states[-1], at, kinds[masks[-1]])
        return cost, "".join(letters)


_repairs = Repairs()


# -- rows


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the test damage, which crc32 of ``conv_id:turn`` decides row by row."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select(
        "conv_id", "turn", fate.alias("fate"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    ).where("fate <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _marked(turns: DataFrame) -> DataFrame:
    """The rows with a digest of role and text; nulls are one space."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("mark", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def _role_class(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)


def _packed(batches):
    """Sorted rows to one string of symbols for each conversation in a partition."""
    import pyarrow as pa

    names = ["conv_id", "seg", "block", "symbols", "first_turn", "last_turn", "n_turns"]
    out = {n: [] for n in names}
    conv, seg, block, run, turns, n_turns, kinds = None, None, 0, bytearray(), [None, None], 0, None

    def close():
        for n, v in zip(names, (conv, seg, block, bytes(run), *turns, n_turns), strict=True):
            out[n].append(v)

    def flushed():
        types = [kinds[0], pa.int32(), pa.int32(), pa.binary(), kinds[1], kinds[1], pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
        for n in names:
            out[n].clear()
        return made

    for batch in batches:
        kinds = batch.schema.field("conv_id").type, batch.schema.field("turn").type
        for c, t, symbol, again, n, s in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "symbol", "again", "n", "seg")), strict=True):
            if run and (c != conv or len(run) >= PACKED):
                close()
                block = block + 1 if c == conv else 0
                run, turns, n_turns = bytearray(), [None, None], 0
            conv, seg = c, s
            run.append(symbol)
            run.extend([again] * (n - 1))
            if t is not None and t != turns[1]:
                turns, n_turns = [t if turns[0] is None else turns[0], t], n_turns + 1
        if out["conv_id"]:
            yield flushed()
    if run:
        close()
        yield flushed()


def _planned(batches):
    """The symbols of a conversation to its counts, cost and audit."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for pieces in batch.column(1).to_pylist():
            symbols = b"".join(p["symbols"] for p in pieces)
            faults, last, n_turns = [0] * 4, None, 0
            for s in range(16):
                faults[s // 4] += symbols.count(s)
            illegal = sum((x % 4, y % 4) not in LEGAL_PAIRS for x, y in zip(symbols, symbols[1:], strict=False))
            told = [p for p in pieces if p["n_turns"]]
            for p in told:
                n_turns += p["n_turns"] - (p["first_turn"] == last)
                last = p["last_turn"]
            gaps = last - told[0]["first_turn"] + 1 - n_turns if told else 0
            cost, audit = _repairs.repaired(symbols)
            rows.append((gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns)]], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation with rows, as a staged table."""
    rows = _marked(turns)
    text = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(text == "", BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    same = rows.select("conv_id", "turn", "mark", _role_class(F.col("role")).alias("role"), fault.alias("fault")).groupBy("conv_id", "turn", "mark", "role", "fault").agg(F.count("*").cast("int").alias("n"))
    first = same.groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(F.struct("turn")).alias("first"))
    found = same.join(first, same["conv_id"].eqNullSafe(first["_conv"]) & (same["mark"] == first["_mark"]))
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE) * 4 + F.col("role")
    coded = found.select("conv_id", "turn", "mark", F.when(later, again).otherwise(F.col("fault") * 4 + F.col("role")).alias("symbol"), again.alias("again"), "n")
    ordered = coded.repartitionByRange("conv_id", "turn", "mark").sortWithinPartitions("conv_id", "turn", "mark").withColumn("seg", F.spark_partition_id())
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    packed = map_batches(ordered.select("conv_id", "turn", "symbol", "again", "n", "seg"), _packed, f"conv_id {kinds['conv_id']}, seg int, block int, symbols binary, first_turn {kinds['turn']}, last_turn {kinds['turn']}, n_turns long")
    pieces = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "block", "symbols", "first_turn", "last_turn", "n_turns"))).alias("pieces"))
    return staged(map_batches(pieces, _planned, f"conv_id {kinds['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "repairs")


def _applied(batches):
    """Each conversation's audit, then its rows in order, to repaired rows."""
    import pyarrow as pa

    names, kind = ["conv_id", "place", "edit", "role", "text"], None
    out = {n: [] for n in names}
    conv, letters, at, state, place = None, "", 0, START, 0

    def put(edit, role, text):
        nonlocal place
        for n, v in zip(names, (conv, place, edit, role, text), strict=True):
            out[n].append(v)
        place += 1

    def given(edit, text):
        nonlocal state
        role = ASSISTANT if state == ASKED else USER
        state = MOVES[state, role]
        put(edit, ROLE_NAMES[role], text)

    def inserted():
        nonlocal at
        while letters[at : at + 1] == "I":
            given("I", "")
            at += 1

    def flushed():
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
        for n in names:
            out[n].clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, audit, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                inserted()
                conv, letters, at, state, place = c, audit, 0, START, 0
                continue
            inserted()
            letter, at = letters[at], at + 1
            if letter == "K":
                state = MOVES[state, "sua".index(role[0])]
                put("K", role, text)
            elif letter == "R":
                given("R", text)
        if out["conv_id"]:
            yield flushed()
    inserted()
    if out["conv_id"]:
        yield flushed()


def repaired_rows(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text of the repaired conversations; those of one follow each other in order."""
    rows = _marked(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "mark", F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("mark"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "mark")
    return map_batches(ordered.select("conv_id", "audit", "role", "text"), _applied, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string")


def _hashed(batches):
    import pyarrow as pa

    conv, chain, kind, done = None, None, None, []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if chain:
                    done.append((conv, chain.hexdigest()))
                conv, chain = c, hashlib.sha256()
            chain.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
            done = []
    if chain:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([chain.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair_report(turns: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """A row for every conversation of ``originals`` (default: of ``turns``): faults, cost, audit and the repaired text's hash."""
    planned = plans(turns)
    kind = turns.schema["conv_id"].dataType.simpleString()
    hashes = map_batches(repaired_rows(turns, planned), _hashed, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "_hashed")
    every = (originals if originals is not None else turns).select(F.col("conv_id").alias("_every")).distinct()
    rows = every.join(planned, F.col("_every").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_every").eqNullSafe(F.col("_hashed")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("_every").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
