"""Repair of chat logs: the cheapest edits that give each conversation the turn structure ``(s?(ua)+)?``.

Rows are partitioned by conversation once.  Sorted from the last turn to the first, a stream of Arrow
batches carries four numbers from row to row, the least cost of finishing from each state of the structure,
and leaves two bits per state behind: the edit that a cheapest repair takes there.  These backpointers
travel as one byte beside their row, so Spark's sort spills them with it and no conversation, however
long, is held by a task.  Sorted from the first turn on, a second stream follows them and writes the edits;
since different edits of a state have different initials, the least initial at every step gives the least
string among the cheapest repairs.  A third one digests the edits.  Tasks hold one batch, a hash state and
the audit string.

Edits: keep (K, 0), rerole to user or assistant (R, 1), delete (D, 2; the only one for blank and duplicate
rows), insert an empty user or assistant message (I, 5); a truncated row that stays costs 5 more.

Nulls: a null role or text is one space, so such a text is blank; null turns come first; a null conversation
id is a conversation of its own.  Ties: rows of one turn are taken by role and text; of equal rows all but the
first are duplicates.  Empty texts are blank, very long ones only pass through.  An empty table gives an empty
result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "DIKR"
AFTER = (2, 2, 3, 2)
"""The state that a user or assistant message leads to: from nothing, a system, a user, an assistant message."""
ROLES = ("user", "user", "assistant", "user")
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
END = (0, 10, 5, 0)
"""Cost of ending in each state: what is missing is inserted."""
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
NO_ROWS = hashlib.sha256(b"").hexdigest()
LAST = 2**63 - 1


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults by crc32(conversation:turn) % 20: 0 drops a row, 1 empties its text, 2 strips its sentence ends,
    3 repeats it, 4 makes its role user.  Nulls are written as one space, ids and turns in the key alone."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(written(conversation), F.lit(":"), written(turn)).cast("binary")) % 20
    rows = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), written(role).alias("role"),
                       written(text).alias("text"), fault.alias("fault")).filter("fault <> 0")
    new_text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("nth")).drop("nth")


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, was, text, nth, fault): the first of blank, duplicate and truncated that a row shows."""
    same = Window.partitionBy("conv", "was", "text").orderBy("turn")
    counted = rows.repartition("conv").withColumn("nth", F.row_number().over(same))
    text = F.col("text")
    fault = (F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("nth") > 1, "duplicate")
             .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    return counted.withColumn("fault", fault)


@lru_cache(maxsize=1 << 14)
def step(after: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """Least costs before a row (above the least of them) from those after it, and two bits per state: the edit."""
    extra = TRUNCATED if fault == "truncated" else 0
    moves: list[dict[str, int]] = []
    for state in range(4):
        made = {"D": DELETE + after[state]}
        if fault in (None, "truncated"):
            made["R"] = REROLE + extra + after[AFTER[state]]
            kept = KEPT.get(initial, (None,) * 4)[state]
            if kept is not None:
                made["K"] = extra + after[kept]
        moves.append(made)
    best = [min(made.values()) for made in moves]
    for _ in range(3):
        best = [min(cost, INSERT + best[AFTER[state]]) for state, cost in enumerate(best)]
    code = 0
    for state, made in enumerate(moves):
        made["I"] = INSERT + best[AFTER[state]]
        code |= LETTERS.index(min(letter for letter, cost in made.items() if cost == best[state])) << 2 * state
    return tuple(cost - min(best) for cost in best), code


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from last to first, each with its backpointers."""
    conversation, after = object(), END
    for batch in batches:
        codes = []
        for conv, was, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "was", "fault"))):
            if conv != conversation:
                conversation, after = conv, END
            after, code = step(after, was[:1], fault)
            codes.append(code)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], [*batch.schema.names, "code"])


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from first to last become edits; insertions stand where they are made."""
    state, open_ = 0, None
    made: list[tuple] = []

    def insert(conv: object) -> None:
        nonlocal state
        made.append((conv, None, "I", None, None, ROLES[state], ""))
        state = AFTER[state]

    def end() -> None:
        while open_ and state in (1, 2):
            insert(open_[0])

    def edits() -> pa.RecordBatch:
        columns = zip(*made) if made else [[]] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
        made.clear()
        return batch

    schema = None
    for batch in batches:
        conv_type, turn_type = batch.schema.field("conv").type, batch.schema.field("turn").type
        schema = pa.schema([("conv", conv_type), ("turn", turn_type), *((c, pa.string()) for c in ("edit", "fault", "was", "role", "text"))])
        for conv, turn, was, text, fault, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "was", "text", "fault", "code"))):
            if not open_ or conv != open_[0]:
                end()
                state, open_ = 0, (conv,)
            while (letter := LETTERS[code >> 2 * state & 3]) == "I":
                insert(conv)
            role = {"D": None, "K": was, "R": ROLES[state]}[letter]
            made.append((conv, turn, letter, fault, was, role, None if letter == "D" else text))
            if letter != "D":
                state = AFTER[state] if letter == "R" else KEPT[was[:1]][state]
        yield edits()
    if open_:
        end()
        yield edits()


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation, in order: (conv, turn, edit, fault, was, role, text).

    ``was`` is a row's own role and null for insertions; role and text are null for deletions.  A conversation
    lies in one partition, its edits one after the other.
    """
    chosen = rows.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"),
                         *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "was"), (text, "text"))))
    order = ("turn", "was", "text", "nth")
    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in ("conv", "turn"))
    told = (faults(chosen).sortWithinPartitions("conv", *(F.desc_nulls_last(c) for c in order))
            .mapInArrow(backward, f"{kinds}, was string, text string, nth int, fault string, code int"))
    return (told.sortWithinPartitions("conv", *(F.asc_nulls_first(c) for c in order))
            .mapInArrow(forward, f"{kinds}, edit string, fault string, was string, role string, text string"))


def repaired(rows: DataFrame, **columns: str) -> DataFrame:
    """The messages that are left or inserted, in order within their partition: (conv, turn, role, text)."""
    return repair(rows, **columns).filter("edit <> 'D'").select("conv", "turn", "role", "text")


class Digest:
    """What is reported of one conversation, from its edits in order."""

    def __init__(self, conv: object):
        self.conv, self.faults, self.audit, self.sha = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, [], hashlib.sha256()
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = self.messages = 0

    def add(self, turn: int | None, edit: str, fault: str | None, was: str | None, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            self.illegal += self.before is not None and self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
        if edit != "D":
            self.sha.update(("\n" if self.messages else "").encode() + f"{role}:{text}".encode())
            self.messages += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LAST)
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits."""
    def rows(done: list[Digest]) -> pa.RecordBatch:
        columns = zip(*(d.row() for d in done)) if done else [[]] * 9
        kinds = (conv_type, *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    open_, conv_type = None, None
    for batch in batches:
        conv_type, done = batch.schema.field("conv").type, []
        for conv, *edit in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ is None or conv != open_.conv:
                done += [open_] if open_ else []
                open_ = Digest(conv)
            open_.add(*edit)
        yield rows(done)
    if open_:
        yield rows([open_])


def report(rows: DataFrame, of: DataFrame | None = None, conversation: str = "conv_id", **columns: str) -> DataFrame:
    """Faults, cost, audit and the repaired text's hash per conversation.

    ``of`` may name conversations of which no row is left; they get zeros, an empty audit and the empty hash.
    """
    edits = repair(rows, conversation=conversation, **columns)
    kind = edits.schema["conv"].dataType.simpleString()
    found = edits.mapInArrow(digests, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    if of is None:
        return found
    names = of.groupBy(F.col(conversation).alias("name")).agg(F.lit(1).alias("one")).select("name")
    empty: dict[str, Column] = {**{c: F.lit(0).cast("long") for c in COUNTS}, "audit": F.lit(""), "repaired_sha256": F.lit(NO_ROWS)}
    return (names.join(found, F.col("name").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("name").alias("conv_id"), *(F.coalesce(c, x).alias(c) for c, x in empty.items())))
