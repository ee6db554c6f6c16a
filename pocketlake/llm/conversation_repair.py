"""Repair of the turn structure of conversations: the cheapest edits that make the roles alternate.

Rows of a conversation are sorted once, each in two copies: a small one (initial of the role and fault) at minus its place, and one with the text
at plus its place. So a task that reads a conversation in order meets it backwards first and forwards then. Going backwards it
computes the costs to the end, and keeps them only at checkpoints: one each k rows, k doubling as the rows do, thus about the square root
of their number. Going forwards it holds the rows between two checkpoints, computes their costs anew from the later one, and walks along
edits that lose nothing, the ASCII-least first. A task holds checkpoints and one such block, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import field

#: White space, and what ends a sentence.
SPACE, ENDS = r"[\x20\x09-\x0D]", "[.!?]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row. The role that each asks for, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
#: Faults, the first of a row that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def follow(state: int, initial: str) -> int:
    """The state after a kept row with a role of this initial; -1 if the row can't stand here. A role without any letter changes nothing."""
    if not initial:
        return state
    if initial == "s":
        return SYSTEM if state == START else -1
    return NEXT[state] if initial == WANTED[state][0] else -1


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to the end from each state if rows may be inserted first."""
    once = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return [min(once[s], INSERT + once[NEXT[s]]) for s in range(4)]


#: Costs after the last row.
AT_END = with_inserts([0, NEVER, NEVER, 0])


def edit_costs(state: int, initial: str, fault: int, after: list[int]) -> tuple[int, int, int]:
    """Costs to the end if the row is deleted, kept or given the role that is due."""
    delete = DELETE + after[state]
    if fault in (BLANK, DUPLICATE):
        return delete, NEVER, NEVER
    more = TRUNCATED if fault == CUT else 0
    kept = follow(state, initial)
    return delete, NEVER if kept < 0 else KEEP + more + after[kept], REROLE + more + after[NEXT[state]]


def before(initial: str, fault: int, after: list[int]) -> list[int]:
    """Costs to the end from each state before a row, given those after it."""
    return with_inserts([min(edit_costs(s, initial, fault, after)) for s in range(4)])


class Checkpoints:
    """Costs at every k-th row from the end; k doubles when 2 k of them are held."""

    def __init__(self):
        self.every, self.rows, self.costs = 8, 0, AT_END
        self.held = {0: AT_END}

    def add(self, initial: str, fault: int) -> None:
        """A row further backwards."""
        self.costs = before(initial, fault, self.costs)
        self.rows += 1
        if self.rows % self.every == 0:
            self.held[self.rows] = self.costs
            if len(self.held) > 2 * self.every:
                self.every *= 2
                self.held = {n: c for n, c in self.held.items() if n % self.every == 0}


class Walk:
    """Forward through a conversation whose costs are known at checkpoints."""

    def __init__(self, checkpoints: Checkpoints):
        self.checks, self.left, self.state, self.block = checkpoints, checkpoints.rows, START, []
        self.costs = checkpoints.costs
        self.cost = self.costs[START]

    def add(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of the rows that are settled now; role and text are those after the edit, null for deleted rows."""
        self.block.append((role, text, fault))
        if (self.left - len(self.block)) % self.checks.every == 0:
            yield from self._settle()

    def _settle(self) -> Iterator[tuple[str, str | None, str | None]]:
        self.left -= len(self.block)
        behind = [self.checks.held[self.left]]
        for role, _, fault in reversed(self.block):
            behind.append(before(role[:1], fault, behind[-1]))
        behind.pop()
        for role, text, fault in self.block:
            after = behind.pop()
            while True:
                due = self.costs[self.state]
                delete, keep, rerole = edit_costs(self.state, role[:1], fault, after)
                if delete == due:
                    yield "D", None, None
                elif INSERT + self.costs[NEXT[self.state]] == due:
                    yield "I", WANTED[self.state], ""
                    self.state = NEXT[self.state]
                    continue
                elif keep == due:
                    yield "K", role, text
                    self.state = follow(self.state, role[:1])
                else:
                    assert rerole == due
                    yield "R", WANTED[self.state], text
                    self.state = NEXT[self.state]
                break
            self.costs = after
        self.block = []

    def end(self) -> Iterator[tuple[str, str, str]]:
        """The rows to insert after the last."""
        while self.state not in (START, ASSISTANT):
            yield "I", WANTED[self.state], ""
            self.state = NEXT[self.state]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): rows with faults put in by the checksum of ``conv:turn``; rows to drop are marked, repeated ones there twice."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    lot = (F.crc32(name.cast("binary")) % 20).cast("int")
    body, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    body = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(body, ENDS, "")).otherwise(body)
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(lot == 4, "user").otherwise(who).alias("role"), body.alias("text"),
        (lot == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(lot == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their ``place`` in the conversation and their first ``fault``; dropped ones have neither. One exchange, by conversation."""
    seen = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_seen")
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){SPACE}*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("_seen") > 1, DUPLICATE).when(~last.rlike(ENDS), CUT).otherwise(SOUND)
    rows = rows.repartition("conv").withColumn("_seen", F.row_number().over(seen)).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.withColumns({"fault": F.when(~F.col("dropped"), fault), "place": F.when(~F.col("dropped"), F.col("place"))})


def both_ways(rows: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text, fault) sorted by place within conversations: backwards at negative places, where the role is its
    initial and there is no text, then forwards. A dropped row keeps place 0."""
    rows = rows.withColumn("_way", F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(1)))))
    ahead = F.col("_way") == 1
    kept = rows.select(
        "conv", F.coalesce(F.col("place") * F.col("_way"), F.lit(0).cast("long")).alias("place"), F.when(ahead, F.col("turn")).alias("turn"),
        F.when(ahead, F.col("role")).otherwise(F.substring("role", 1, 1)).alias("role"), F.when(ahead, F.col("text")).alias("text"), F.col("fault").cast("int").alias("fault"),
    )
    return kept.sortWithinPartitions("conv", "place")


class Conversation:
    """What is counted of a conversation as its rows pass, backwards and then forwards."""

    def __init__(self, conv):
        self.conv = conv
        self.checks, self.walk = Checkpoints(), None
        self.turns: list[int] = [0, 0, 0]
        self.counts = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.kept = 0

    def pass_row(self, place: int, turn, role: str, text: str, fault: int) -> Iterator[tuple[str, str | None, str | None]]:
        if place < 0:
            self.checks.add(role, fault)
        elif place > 0:
            self.walk = self.walk or Walk(self.checks)
            self.counts[fault] += 1
            if turn is not None:
                least, most, several = self.turns
                self.turns = [turn, turn, 1] if not several else [least, turn, several + (turn != most)]
            initial = role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            yield from self.noted(self.walk.add(role, text, fault))

    def noted(self, edits) -> Iterator[tuple[str, str | None, str | None]]:
        for edit, role, text in edits:
            self.audit.append(edit)
            if role is not None:
                self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
                self.kept += 1
            yield edit, role, text

    def finish(self) -> Iterator[tuple[str, str | None, str | None]]:
        if self.walk:
            yield from self.noted(self.walk.end())

    def summary(self) -> tuple:
        least, most, several = self.turns
        cost = self.walk.cost if self.walk else 0
        gaps = most - least + 1 - several if several else 0
        return (self.conv, gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[tuple], bool]]:
    """(conversation, edits, whether it has ended) for each row of sorted batches."""
    now: Conversation | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for conv, *row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now, now.finish(), True
                    now = Conversation(conv)
                yield now, now.pass_row(*row), False
    if now is not None:
        yield now, now.finish(), True


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def audits(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation of ``damaged`` rows.

    Rows are taken by turn (nulls first), equal turns by role and text. Faults: blank (nothing but white space), duplicate (role and text
    seen earlier), truncated (the last character that is not white space ends no sentence); a row has its first one. Edits: K keep, R
    another role (2), D delete (3, needed for blank and duplicate rows), I insert an empty row (2); a truncated row that stays costs 1. The
    audit is the cheapest list of edits after which the initials of the roles read ``(s?(ua)+)?``, of several the ASCII-least. A row with an
    empty role has no initial. A conversation without rows left has zeros and an empty audit; a null id is one conversation.

    A conversation is hashed in order by one task, which holds no more of its texts than lie between two checkpoints.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    schema = T.StructType([field(rows, "conv", conv), *(T.StructField(n, T.LongType()) for n in SUMMARY[:6]), *(T.StructField(n, T.StringType()) for n in SUMMARY[6:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, made = None, []

        def batch() -> pa.RecordBatch:
            columns = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names=[conv, *SUMMARY])

        def noting() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for now, edits, ended in passed(noting()):
            for _ in edits:
                pass
            if ended:
                made.append(now.summary())
                if len(made) >= 1000:
                    yield batch()
                    made.clear()
        if made:
            yield batch()

    return both_ways(faults(rows)).mapInArrow(run, schema)


def repaired(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, place, edit, role, text): the edits of each conversation in order with the rows that they leave; null role and text for a deleted row."""
    schema = T.StructType([
        field(rows, "conv", conv), T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, made = None, []

        def batch() -> pa.RecordBatch:
            columns = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.int64(), *[pa.string()] * 3], strict=True)], names=[conv, "place", "edit", "role", "text"])

        def noting() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for now, edits, _ in passed(noting()):
            for edit in edits:
                made.append((now.conv, len(now.audit), *edit))
                if len(made) >= 1000:
                    yield batch()
                    made.clear()
        if made:
            yield batch()

    return both_ways(faults(rows)).mapInArrow(run, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repaired`` for rows as they are, without damage. Null roles and texts count as one space."""
    blank = F.lit(" ")
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"), F.lit(False).alias("dropped"))
    return repaired(plain, conv)
