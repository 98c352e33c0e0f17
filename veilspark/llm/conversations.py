"""Conversation structure repair by depth-first branch and bound.

The rows of a conversation, by turn (nulls first, then by role and text), are edited so
that the initials of their roles read `(s?(ua)+)?`: Keep (K) costs nothing, Rerole (R)
to user or assistant 3, Delete (D) 4, Insert (I) of an empty user or assistant row 3. A
blank row (no character but ASCII white space) and a duplicate (role and text stand in
an earlier row) must be deleted; a truncated row (last such character not one of .!?)
costs 3 more unless it is deleted. The repair is the cheapest one, among these the one
with the ASCII-least audit, the initials of its edits in order.

The search keeps an explicit stack of prefixes and takes D, I, K, R in that order, so
audits come up in ASCII order. Suffix bounds, made backwards for each place and state of
the pattern, say what the rest costs at least; a prefix that cannot beat the incumbent
(cost, audit) is dropped, and a table per node (place, state) drops prefixes that are no
better than one that was there before.

Rows are sorted by ranges, not grouped: a long conversation spreads over tasks and is
held as chunks of at most CHUNK rows. Chunks of a conversation that is cut are solved
for each state before and after them; 32 small numbers a chunk (cost, and rank of the
audit) decide which states the whole takes, as two prefixes with the same rows differ
before either ends. Then each chunk is edited by itself. Only the hash of a whole
conversation is a pass over its rows in order, in bounded memory.

Null roles and texts are one space. A null conv_id is a conversation of its own. Equal
rows are copies of one another: the first counts, the others are duplicates. Rows with
0 copies only name their conversation, which comes out even if it has no row left.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters to a chunk (one row at least).
CHUNK, CHUNK_CHARS = 1000, 4_000_000
BLANK = " \t\n\x0b\x0c\r"
#: States of the pattern: nothing yet, behind s, behind u, behind a. STEP: where a kept role leads; NEXT: where the role does that fits.
STATES, ENDS = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
NEVER = 1 << 40
MOST = (1 << 63) - 1


def kind_of(role: str, text: str, duplicate: bool) -> tuple[str, str]:
    """(first fault, code) of a row: - must go, s u a x (another role) may stay, in capitals if truncated."""
    seen = text.rstrip(BLANK)
    if not seen:
        return "blank", "-"
    if duplicate:
        return "duplicate", "-"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return ("", code) if seen[-1] in ".!?" else ("truncated", code.upper())


def moves(code: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows taken, next state) of the edits at a row (code) or behind the last one (empty)."""
    if code:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, NEXT[state]
    if code and code != "-":
        extra = TRUNCATED if code.isupper() else 0
        if (to := STEP.get((state, code.lower()))) is not None:
            yield "K", extra, 1, to
        yield "R", REROLE + extra, 1, NEXT[state]


def suffix_bounds(codes: str, end: int) -> list[list[int]]:
    """For each place and state, the least cost of what follows, if the last row leads to state `end`."""
    below = [0 if state == end else NEVER for state in STATES]
    out = [below]
    for code in reversed(codes):
        here = [min(c + below[to] for _, c, taken, to in moves(code, state) if taken) for state in STATES]
        for _ in range(2):  # inserts; a third one leads back to where the first began
            here = [min(here[state], INSERT + here[NEXT[state]]) for state in STATES]
        out.append(here)
        below = here
    return out[::-1]


def search(codes: str, begin: int, end: int) -> tuple[int, str] | None:
    """The incumbent (cost, audit) that is proved best from state `begin` to `end`, the last edit taking the last row."""
    bounds = suffix_bounds(codes, end)
    limit = bounds[0][begin]
    if limit >= NEVER:
        return None
    best: tuple[int, str] | None = None
    dominant: dict[tuple[int, int], int] = {}
    trail: list[tuple[int, str]] = []
    stack = [(0, 0, begin, -1)]
    while stack:
        cost, at, state, last = stack.pop()
        if cost + bounds[at][state] > limit or (best and cost + bounds[at][state] >= best[0]):
            continue
        # prefixes come up in ASCII order: one that costs no less than an earlier one is worse
        if dominant.get((at, state), NEVER) <= cost:
            continue
        dominant[at, state] = cost
        if at == len(codes):
            if state == end:
                best = min(x for x in (best, (cost, audit_of(trail, last))) if x)
            continue
        branches = []
        for letter, more, taken, to in moves(codes[at], state):
            if cost + more + bounds[at + taken][to] <= limit:
                trail.append((last, letter))
                branches.append((cost + more, at + taken, to, len(trail) - 1))
        stack += reversed(branches)
    return best


def audit_of(trail: list[tuple[int, str]], last: int) -> str:
    letters = []
    while last >= 0:
        last, letter = trail[last]
        letters.append(letter)
    return "".join(reversed(letters))


@lru_cache(maxsize=50_000)
def summary(codes: str) -> tuple[list[int], list[int]]:
    """Cost and rank of the audit (among those from one state) from each state to each, state by state; NEVER where there is none."""
    costs, ranks = [], []
    for begin in STATES:
        found = [search(codes, begin, end) for end in STATES]
        order = sorted(f[1] for f in found if f)
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(f[1]) if f else 0 for f in found]
    return costs, ranks


def tail(state: int) -> tuple[int, str]:
    """Cost and audit of the inserts that end a conversation."""
    n = 0
    while state not in ENDS:
        state, n = NEXT[state], n + 1
    return n * INSERT, "I" * n


def path(parts: list[tuple[list[int], list[int]]]) -> list[int]:
    """The states between consecutive chunks (costs, ranks) on the best repair, from the beginning to the end."""
    ahead = [[tail(state)[0] for state in STATES]]
    for costs, _ in reversed(parts):
        ahead.append([min(costs[4 * a + b] + ahead[-1][b] for b in STATES) for a in STATES])
    ahead.reverse()
    states = [0]
    for k, (costs, ranks) in enumerate(parts):
        a = states[-1]
        states.append(min((costs[4 * a + b] + ahead[k + 1][b], ranks[4 * a + b], b) for b in STATES)[2])
    return states


def edited(codes: str, roles: list[str], texts: list[str], begin: int, audit: str) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    out, at, state = [], 0, begin
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        state = STEP[state, codes[at].lower()] if letter == "K" else NEXT[state]
        out.append((roles[at] if letter == "K" else NAMES[state], texts[at]))
        at += 1
    return out


# --- rows to chunks


def flagged(rows: DataFrame, copies: Column) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with copies and again (an equal role and text stand at an earlier turn)."""
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"),
    )
    once = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("h", F.unhex(F.md5("text")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = once.filter("copies > 0").groupBy("conv_id", "role", "h").agg(F.min(turn).alias("first"))
    first = first.toDF("of", "first_role", "first_h", "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("first_role")) & (F.col("h") == F.col("first_h"))
    again = F.coalesce(turn > F.col("first"), F.lit(False))
    return once.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", again.alias("again"))


CHUNKS = {
    "conv_id": None, "seq": pa.int64(), "whole": pa.bool_(), "codes": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
    "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "initials": pa.list_(pa.string()),
    "turns": pa.list_(pa.int64()), "distinct": pa.int64(),
}


class Chunk:
    """Consecutive rows of a conversation."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, [], [], [], 0
        self.faults = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.distinct = 0, [], 0

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        fault, code = kind_of(role, text, duplicate)
        self.faults[fault] += 1
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None:
            if not self.turns or self.turns[-1] != turn:
                self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]

    def row(self, seq: int, whole: bool) -> tuple:
        f = self.faults
        return (
            self.conv, seq, whole, "".join(self.codes), self.roles, self.texts, f["blank"], f["duplicate"], f["truncated"], self.illegal,
            [self.roles[0][:1], self.roles[-1][:1]] if self.roles else [], self.turns, self.distinct,
        )


def chunks(rows: DataFrame, copies: Column | None = None, most: int = CHUNK) -> DataFrame:
    """Chunks of conversations in order of (part, seq); whole: the chunk is known to be all of its conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk waits until the next row shows whether its conversation goes on; the first and last conversation may go on in other tasks
        now, seq, edge, alone = None, 0, True, True
        for batch in batches:
            out, own = [], batch.schema.field("conv_id").type
            for conv, turn, role, text, n, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row(seq, alone and not edge))
                        seq, edge = seq + 1, False
                    now, alone = Chunk(conv), True
                for k in range(n):
                    if len(now.codes) >= most or now.chars >= CHUNK_CHARS:
                        out.append(now.row(seq, False))
                        now, seq, alone = Chunk(conv), seq + 1, False
                        if len(out) * most >= 64 * CHUNK:
                            yield table_of(out, CHUNKS, own)
                            out = []
                    now.add(turn, role, text, again or k > 0)
            if out:
                yield table_of(out, CHUNKS, own)
        if now is not None:
            yield table_of([now.row(seq, False)], CHUNKS, own)

    kinds = "seq long, whole boolean, codes string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long"
    kinds = f"conv_id {kind}, {kinds}, illegal long, initials array<string>, turns array<long>, distinct long"
    flags = flagged(rows, F.lit(1) if copies is None else copies)
    # equal keys go to one range; longer texts than the key shows are put in order inside it
    ranged = flags.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 40)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.mapInArrow(cut, kinds).withColumn("part", F.spark_partition_id())


def table_of(rows: list[tuple], types: dict, conv: pa.DataType | None = None) -> pa.RecordBatch:
    """A batch of rows; conv: the type of conv_id."""
    types = types if conv is None else types | {"conv_id": conv}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


# --- chunks to repairs


def states_between(cut: DataFrame) -> DataFrame:
    """(part, seq, begin, end, last) of the chunks whose conversation may have several."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [summary(codes) for codes in batch.column("codes").to_pylist()]
            numbers = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq")), *numbers], ["conv_id", "part", "seq", "costs", "ranks"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"part": pa.int32(), "seq": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "last": pa.bool_()}
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                states = path([(p["costs"], p["ranks"]) for p in parts])
                out += [(p["part"], p["seq"], a, b, p is parts[-1]) for p, a, b in zip(parts, states, states[1:])]
            if out:
                yield table_of(out, types)

    kind = cut.schema["conv_id"].dataType.simpleString()
    numbers = cut.select("conv_id", "part", "seq", "codes").mapInArrow(summed, f"conv_id {kind}, part int, seq long, costs array<long>, ranks array<long>")
    whole = numbers.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "costs", "ranks"))).alias("parts"))
    return whole.select("parts").mapInArrow(chosen, "part int, seq long, begin int, end int, last boolean")


def repaired(rows: DataFrame, copies: Column | None = None, most: int = CHUNK) -> DataFrame:
    """The chunks with begin, last, cost, audit and kept, the repaired rows (role, text) of each in order."""
    made = stored(chunks(rows, copies, most), "chunks")
    several = made.filter("not whole")
    choice = states_between(several).toDF("of_part", "of_seq", "begin", "end", "last")
    parts = several.join(choice, (F.col("part") == F.col("of_part")) & (F.col("seq") == F.col("of_seq"))).drop("of_part", "of_seq")
    alone = made.filter("whole").select("*", F.lit(0).alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("last"))
    both = parts.unionByName(alone)
    names, pairs = both.columns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, roles, texts, begin, end, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "roles", "texts", "begin", "end", "last"))):
                if end is None:
                    end = path([summary(codes)])[1]
                cost, audit = search(codes, begin, end)
                more, behind = tail(end) if last else (0, "")
                kept = [{"role": r, "text": t} for r, t in edited(codes, roles, texts, begin, audit + behind)]
                out.append((cost + more, audit + behind, kept))
            if out:
                found = table_of(out, {"cost": pa.int64(), "audit": pa.string(), "kept": pairs})
                yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], [*batch.schema.names, *found.schema.names])

    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in names)
    return both.mapInArrow(solved, f"{kinds}, cost long, audit string, kept array<struct<role:string,text:string>>")


def repaired_rows(done: DataFrame) -> DataFrame:
    """(conv_id, part, seq, at, role, text) of repaired(): the rows of each conversation in order of part, seq and at."""
    return done.select("conv_id", "part", "seq", F.posexplode("kept").alias("at", "row")).select("conv_id", "part", "seq", "at", "row.role", "row.text")


REPORT = {
    "conv_id": None, "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
    "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}


class Report:
    """What is told of a conversation, chunk by chunk."""

    def __init__(self, conv):
        self.conv, self.sums, self.distinct, self.turns, self.last = conv, [0] * 5, 0, None, None
        self.audit, self.hash, self.any = [], hashlib.sha256(), False

    def add(self, chunk: dict) -> None:
        self.sums = [a + chunk[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"))]
        if chunk["initials"]:
            if self.last is not None:
                self.sums[3] += self.last + chunk["initials"][0] not in ("su", "ua", "au")
            self.last = chunk["initials"][1]
        if chunk["turns"]:
            first, end = chunk["turns"]
            self.distinct += chunk["distinct"] - (self.turns is not None and self.turns[1] == first)
            self.turns = (self.turns[0] if self.turns else first, end)
        self.audit.append(chunk["audit"])
        for row in chunk["kept"]:
            self.hash.update((self.any * "\n" + f"{row['role']}:{row['text']}").encode())
            self.any = True

    def row(self) -> tuple:
        blank, duplicate, truncated, illegal, cost = self.sums
        gaps = min(self.turns[1] - self.turns[0] + 1 - self.distinct, MOST) if self.turns else 0
        return self.conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(self.audit), self.hash.hexdigest()


def report(done: DataFrame) -> DataFrame:
    """One row per conversation of repaired(): gaps, faults, illegal, cost, audit, repaired_sha256."""
    told = ["conv_id", "part", "seq", "initials", "turns", "distinct", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "kept"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out, own = [], batch.schema.field("conv_id").type
            for a in range(0, batch.num_rows, 200):
                for chunk in batch.slice(a, 200).to_pylist():
                    if now is None or now.conv != chunk["conv_id"]:
                        if now is not None:
                            out.append(now.row())
                        now = Report(chunk["conv_id"])
                    now.add(chunk)
            if out:
                yield table_of(out, REPORT, own)
        if now is not None:
            yield table_of([now.row()], REPORT, own)

    kind = done.schema["conv_id"].dataType.simpleString()
    kinds = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    done = stored(done.select("whole", *told), "repaired")
    alone = done.filter("whole").select(*told).mapInArrow(fold, kinds)
    joined = done.filter("not whole").select(*told).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return alone.union(joined.mapInArrow(fold, kinds))
