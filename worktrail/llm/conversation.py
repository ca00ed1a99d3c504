"""Repair of conversation structure: the cheapest edits that give a well-formed dialogue.

Rows of a conversation, in order of turn, are kept (cost 0), given the role
user or assistant (2), deleted (3), or joined by inserted empty turns (2), so
that the initials of the roles read `(s?(ua)+)?`. Blank and repeated rows have
to go; a row that ends without `.`, `!` or `?` costs 1 more if it stays. Of
equally cheap edits the ones whose letters (D, I, K, R) come first in ASCII
order are taken.

Rows are dealt by conversation and sorted by turn, and two passes stream over
them, each with a state of a few numbers whatever the length of a conversation:
the first runs backwards, carries the cost to the end from each of the four
states of the grammar, and leaves one byte a row, the best edit from each state
(the back pointers; Spark's sort spills them with the rows); the second runs
forwards and follows the bytes.

Defined results: null role or text counts as one space; null turns come first;
rows of one turn are in order of role and text; a null conversation id is a
conversation of its own; equal rows are repeats, so all but one are deleted.
Only the named columns are read. Without rows nothing returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Costs of the edits, white space, ends of sentences.
RETITLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
FAULTS = ["blank", "duplicate", "truncated"]

# States of the grammar: nothing yet, after s, after u, after a. A turn added in
# a state leads to the one named here.
ADDED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}  # initial s, u, a, other: state before to state after
AT_END = (0, 2 * INSERT, INSERT, 0)
EDITS = "DIKR"


def backward(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end before a row from those after it, and its byte of edits.

    `kind` is 3 * initial (s, u, a, other) + 0 sound, 1 truncated, 2 to delete.
    """
    initial, state = divmod(kind, 3)
    options = []
    for q in range(4):
        of = {"D": DELETE + costs[q]}
        if state < 2:
            extra = TRUNCATED * state
            if q in KEPT[initial]:
                of["K"] = extra + costs[KEPT[initial][q]]
            of["R"] = extra + RETITLE + costs[ADDED[q]]
        options.append(of)
    best = [min(of.values()) for of in options]
    for _ in range(3):
        best = [min(best[q], INSERT + best[ADDED[q]]) for q in range(4)]
    byte = 0
    for q, of in enumerate(options):
        of["I"] = INSERT + best[ADDED[q]]
        edit = min(e for e in of if of[e] == best[q])
        byte |= EDITS.index(edit) << 2 * q
    return tuple(best), byte


def kinds(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """Rows with their fault and kind, dealt by conversation.

    `present` false: the row lends its conversation's id and nothing else.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), here.alias("present"),
    ).repartition("conv")
    # Equal rows are together by the same exchange, as they share a conversation.
    same = W.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    numbered = rows.withColumn("nth", F.row_number().over(same)).withColumn(
        "fault", F.when(~F.col("present"), None).when(stripped == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(stripped, F.lit(1)).isin(*STOPS), "truncated")
    )
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    state = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    return numbered.withColumn("kind", F.when(F.col("present"), 3 * first + state).otherwise(-1))


def _follow(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, each with its byte of edits."""
    schema = T.StructType([*rows.schema.fields, T.StructField("edits", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        conv, costs = object(), AT_END
        for batch in batches:
            bytes_ = []
            for c, kind in zip(batch.column("conv").to_pylist(), batch.column("kind").to_pylist()):
                if c != conv:
                    conv, costs = c, AT_END
                if kind < 0:
                    bytes_.append(-1)
                    continue
                # Only differences count; there are few, so each step is worked out once.
                if (costs, kind) not in known:
                    after, byte = backward(costs, kind)
                    least = min(after)
                    known[costs, kind] = tuple(x - least for x in after), byte
                costs, byte = known[costs, kind]
                bytes_.append(byte)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bytes_, pa.int32())], names=schema.fieldNames())

    back = rows.sortWithinPartitions(F.col("conv").desc(), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("nth"))
    return back.mapInArrow(run, schema).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "nth")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(batch, steps) with steps (conversation, edit, role, row of the batch).

    Inserted turns have no row; rows that are not present have no edit.
    """
    conv, q = None, None

    def finish() -> Iterator[tuple]:
        state = q
        while state in (1, 2):
            state = ADDED[state]
            yield conv, "I", ROLE[state], None

    last = None
    for batch in batches:
        steps, last = [], batch
        columns = (batch.column(c).to_pylist() for c in ("conv", "role", "kind", "edits"))
        for i, (c, role, kind, edits) in enumerate(zip(*columns)):
            if q is None or c != conv:
                steps += finish()
                conv, q = c, 0
            if edits < 0:
                steps.append((c, None, None, i))
                continue
            while (edit := EDITS[edits >> 2 * q & 3]) == "I":
                q = ADDED[q]
                steps.append((c, "I", ROLE[q], None))
            if edit == "K":
                q = KEPT[kind // 3][q]
            elif edit == "R":
                q = ADDED[q]
                role = ROLE[q]
            steps.append((c, edit, role, i))
        yield batch, steps
    if last is not None:
        yield last, list(finish())


def repair(df: DataFrame, **columns) -> DataFrame:
    """Every edit in order: conv, step, edit, turn, role, text, fault.

    The repaired conversation is the rows with edit K, R or I. Deleted rows
    come with what they held; inserted ones have no turn and an empty text.
    """
    rows = _follow(kinds(df, **columns))
    kept = {f.name: f for f in rows.schema.fields}
    text = T.StringType()
    schema = T.StructType([kept["conv"], T.StructField("step", T.LongType()), T.StructField("edit", text), kept["turn"], T.StructField("role", text), T.StructField("text", text), T.StructField("fault", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, step = object(), 0
        for batch, steps in _steps(batches):
            steps = [s for s in steps if s[1]]
            numbers = []
            for c, *_ in steps:
                conv, step = c, step + 1 if c == conv else 0
                numbers.append(step)
            at = pa.array([s[3] for s in steps], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([s[0] for s in steps], batch.column("conv").type), pa.array(numbers, pa.int64()), pa.array([s[1] for s in steps], pa.string()),
                batch.column("turn").take(at), pa.array([s[2] for s in steps], pa.string()), batch.column("text").take(at).fill_null("").cast(pa.string()), batch.column("fault").take(at).cast(pa.string()),
            ], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


SUMMARY = ["gaps", *FAULTS, "illegal", "cost"]


class _Fold:
    """Counts, audit and digest of the conversation that streams past."""

    def __init__(self, conv) -> None:
        self.conv, self.counts = conv, dict.fromkeys(SUMMARY, 0)
        self.audit, self.digest, self.empty = bytearray(), hashlib.sha256(), True
        self.first, self.turn, self.turns, self.initial = None, None, 0, None

    def row(self, turn, fault, initial: str) -> None:
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1

    def edit(self, edit: str, role: str, text: str, fault) -> None:
        self.audit += edit.encode()
        self.counts["cost"] += {"D": DELETE, "I": INSERT, "K": 0, "R": RETITLE}[edit]
        if edit == "D":
            return
        self.counts["cost"] += TRUNCATED * (fault == "truncated")
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def done(self) -> tuple:
        self.counts["gaps"] = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, *self.counts.values(), self.audit.decode(), self.digest.hexdigest())


def summaries(df: DataFrame, **columns) -> DataFrame:
    """One row per conversation: conv, gaps, faults, illegal neighbours, cost,
    audit (the edits' letters) and the SHA-256 of the repaired `role:text` lines.

    Folds the same steps as `repair` as they stream past.
    """
    rows = _follow(kinds(df, **columns))
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([rows.schema["conv"], *[T.StructField(c, long) for c in SUMMARY], T.StructField("audit", text), T.StructField("repaired_sha256", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch, steps in _steps(batches):
            turns, roles, texts, faults = (batch.column(c).to_pylist() for c in ("turn", "role", "text", "fault"))
            out = []
            for conv, edit, role, i in steps:
                if fold is None or fold.conv != conv:
                    out += [fold.done()] if fold else []
                    fold = _Fold(conv)
                if edit and i is not None:
                    fold.row(turns[i], faults[i], roles[i][:1])
                if edit:
                    fold.edit(edit, role, "" if i is None else texts[i], None if i is None else faults[i])
            yield _batch(out, schema, batch.column("conv").type)
            conv_type = batch.column("conv").type
        if fold:
            yield _batch([fold.done()], schema, conv_type)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType, conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * len(SUMMARY), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.fieldNames())
