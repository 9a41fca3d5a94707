"""Conversation repair: cheapest edits to alternating turns, by a DP that streams over sorted turns."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of

HELD = 8 << 20  # bytes of backpointers, and of waiting turns, that a task keeps in memory; more go to its scratch file
ROWS = 10_000  # edits in one batch, about
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # what edits cost; a truncated turn that stays adds 1
FAULTS = ("blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = range(1, 4)
# Roles so far: none, `s`, up to a `u`, up to an `a`. Turns may end at none and after an `a`.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def _wanted(state: int) -> str:
    """The only role, `u` or `a`, that may follow without a system turn."""
    return "a" if state == 2 else "u"


@cache
def _moves(state: int, initial: str, fault: int) -> list[tuple[int, int, str]]:
    """(cost, new state, edits) for one turn from a state: some insertions, then Keep, Rerole or Delete."""
    out, cost, edits = [], 0, ""
    for _ in range(4):  # a fourth insertion only repeats the state after the second
        out.append((cost + DELETE, state, edits + "D"))
        if fault not in (BLANK, DUPLICATE):
            left = 1 if fault == TRUNCATED else 0
            if (state, initial) in NEXT:
                out.append((cost + KEEP + left, NEXT[state, initial], edits + "K"))
            out.append((cost + REROLE + left, NEXT[state, _wanted(state)], edits + "R"))
        cost, edits, state = cost + INSERT, edits + "I", NEXT[state, _wanted(state)]
    return out


# A step's state: for each of the four role states its cost above the cheapest and the place of its edits in ASCII
# order among the four, or None where it can't be reached. Edits up to a turn end with that turn's edit, so none
# is the beginning of another, and their order never changes by what follows.
Front = tuple[tuple[int, int] | None, ...]
START: Front = ((0, 0), None, None, None)


class Steps:
    """Interned DP steps: equal fronts meeting equal kinds of turns give equal steps, so a step is a small number."""

    def __init__(self) -> None:
        self.known: dict[tuple[Front, str, int], int] = {}
        self.steps: list[tuple[Front, int, tuple[tuple[int, str] | None, ...]]] = []

    def take(self, front: Front, initial: str, fault: int) -> int:
        key = (front, initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.known:
            best: dict[int, tuple[int, int, str, int]] = {}
            for state, here in enumerate(front):
                if here is not None:
                    for cost, after, edits in _moves(state, initial, fault):
                        path = (here[0] + cost, here[1], edits, state)
                        if after not in best or path < best[after]:
                            best[after] = path
            least = min(p[0] for p in best.values())
            order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
            after = tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4))
            back = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
            self.known[key] = len(self.steps)
            self.steps.append((after, least, back))
        return self.known[key]

    def finish(self, front: Front) -> tuple[int, int, str]:
        """(cost above the cheapest, state before, insertions at the end) of the best complete path."""
        best = []
        for state, here in enumerate(front):
            if here is not None:
                at, cost, edits = state, here[0], ""
                for _ in range(3):
                    if at in ENDS:
                        best.append((cost, here[1], edits, state))
                    at, cost, edits = NEXT[at, _wanted(at)], cost + INSERT, edits + "I"
        cost, _, edits, state = min(best)
        return cost, state, edits


def _scratch() -> IO[bytes]:
    """A file of this task alone, in the folder where Spark itself spills; it has no name and goes with the task."""
    places = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return tempfile.TemporaryFile(dir=places[0] or None)


class Backpointers:
    """Two bytes a turn: the number of its step. Read from the last turn to the first."""

    def __init__(self) -> None:
        self.tail, self.file, self.stored = array("H"), None, 0

    def add(self, step: int) -> None:
        self.tail.append(step)
        if len(self.tail) * 2 >= HELD:
            self.file = self.file or _scratch()
            self.file.write(self.tail.tobytes())
            self.stored += len(self.tail)
            self.tail = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.tail)
        left = self.stored
        while left:
            n = min(left, HELD // 2)
            left -= n
            self.file.seek(left * 2)
            part = array("H")
            part.frombytes(self.file.read(n * 2))
            yield from reversed(part)


EDITS = ["step", "edit", "turn", "role", "text", "new_role", "fault"]
Turn = tuple[int | None, str, str, int]  # turn, role, text, fault


class Waiting:
    """Turns of one conversation in the order in which they came; long ones wait in the scratch file."""

    def __init__(self) -> None:
        self.tail: list[Turn] = []
        self.size, self.file, self.parts = 0, None, 0

    def add(self, turn: Turn) -> None:
        self.tail.append(turn)
        self.size += 64 + len(turn[1]) + len(turn[2])
        if self.size >= HELD:
            self.file = self.file or _scratch()
            pickle.dump(self.tail, self.file, protocol=pickle.HIGHEST_PROTOCOL)
            self.tail, self.size, self.parts = [], 0, self.parts + 1

    def slices(self) -> Iterator[list[Turn]]:
        if self.parts:
            self.file.seek(0)
            for _ in range(self.parts):
                yield pickle.load(self.file)  # written by this very task
            self.file.close()
        yield self.tail


class Conversation:
    """DP over the turns of one conversation, and the turns that wait for its outcome."""

    def __init__(self, conv_id: object, steps: Steps) -> None:
        self.conv_id, self.steps, self.front = conv_id, steps, START
        self.back, self.waiting, self.last = Backpointers(), Waiting(), None

    def hear(self, turn: int | None, role: str, text: str, initial: str, fault: int) -> None:
        """The next turn, with its fault as Spark found it; equal turns next to each other are told here."""
        if (turn, role, text) == self.last and fault != BLANK:
            fault = DUPLICATE
        self.last = (turn, role, text)
        step = self.steps.take(self.front, initial, fault)
        self.front = self.steps.steps[step][0]
        self.back.add(step)
        self.waiting.add((turn, role, text, fault))

    def edits(self) -> bytes:
        """The cheapest edits in order; D, K, R stand for one turn each."""
        _, state, ends = self.steps.finish(self.front)
        out = bytearray(ends.encode())
        for step in self.back.backwards():
            state, some = self.steps.steps[step][2][state]
            out += some[::-1].encode()
        out.reverse()
        return bytes(out)

    def repaired(self) -> Iterator[list[tuple]]:
        """One row an edit, in slices; a conversation without turns gives one row without an edit."""
        if self.last is None:
            yield [(self.conv_id, *[None] * len(EDITS))]
            return
        edits, at, state = self.edits().decode(), 0, 0
        for part in self.waiting.slices():
            out = []
            for turn, role, text, fault in part:
                while edits[at] == "I":
                    out.append((self.conv_id, at, "I", None, None, "", ROLES[_wanted(state)], None))
                    at, state = at + 1, NEXT[state, _wanted(state)]
                edit, new = edits[at], None
                if edit != "D":
                    letter = role[0] if edit == "K" else _wanted(state)
                    new, state = role if edit == "K" else ROLES[letter], NEXT[state, letter]
                out.append((self.conv_id, at, edit, turn, role, text, new, FAULTS[fault - 1] if fault else None))
                at += 1
            yield out
        out = []
        for at in range(at, len(edits)):
            out.append((self.conv_id, at, "I", None, None, "", ROLES[_wanted(state)], None))
            state = NEXT[state, _wanted(state)]
        yield out


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *EDITS])


def _repair(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns come by conversation and turn; at most one conversation is open, over any number of batches."""
    steps, open_ = Steps(), None
    for batch in batches:
        done: list[tuple] = []
        for conv_id, said, *turn in zip(*[column_of(batch, c).to_pylist() for c in ("conv_id", "said", "turn", "role", "text", "initial", "fault")], strict=True):
            if open_ is None or open_.conv_id != conv_id:
                if open_ is not None:
                    for part in open_.repaired():
                        done += part
                        if len(done) >= ROWS:
                            yield _batch(done, kind)
                            done = []
                open_ = Conversation(conv_id, steps)
            if said:
                open_.hear(*turn)
        yield _batch(done, kind)
    if open_ is not None:
        for part in open_.repaired():
            yield _batch(part, kind)


def _faults(turns: DataFrame) -> DataFrame:
    """Turns with nulls as one space, the role's initial, and the first fault of each.

    A text said before by the same role is found by the first turn in which it is said; repetitions within a
    turn stand next to each other and are left to the stream.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(7), "text")})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    often = rows.groupBy("conv_id", "role", "_h1", "_h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    often = often.select(*[F.col(c).alias(f"o_{c}") for c in ("conv_id", "role", "_h1", "_h2")], "first")
    same = [rows[c].eqNullSafe(often[f"o_{c}"]) for c in ("conv_id", "role", "_h1", "_h2")]
    rows = rows.join(often, same, "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(later, DUPLICATE).when(cut, TRUNCATED).otherwise(0).cast("byte")
    return rows.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.lit(True).alias("said"))


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The cheapest edits that make the role initials of every conversation read `(s?(ua)+)?`.

    `turns` has conv_id, turn, role, text. A turn's first fault counts: blank (nothing but ASCII white space), duplicate
    (role and text said before), truncated (the last other character is none of `.!?`). Keep costs 0, Rerole to user or
    assistant 2, Delete 3 (blank and duplicate turns must go), Insert of an empty user or assistant turn 2; a truncated
    turn that stays adds 1. Among equally cheap edits those whose initials come first in ASCII are taken.

    Returns one row per edit, in order within its conversation: conv_id, step (from 0), edit (K, R, D, I), turn, role,
    text (as found; null turn and role and empty text for I), new_role (null for D), fault. Conversations of `ids`
    (conv_id) without turns have one row with null step and edit.

    Turns are shuffled by conversation, sorted by turn (nulls first, ties by role and text), and streamed: the DP keeps
    four costs, two bytes of backpointers a turn and the turns themselves until the conversation ends; beyond
    8 MB these go to a scratch file of the task, so a giant conversation needs no more memory than others.

    Null role and text count as one space; null and repeated conv_ids and turns are values like others, repeated rows are
    duplicates; an empty table gives no rows but those of `ids`; other columns are ignored.
    """
    rows = _faults(turns)
    kind = rows.schema["conv_id"].dataType
    if ids is not None:
        named = ids.select(F.col("conv_id").cast(kind).alias("conv_id")).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:-1]]
        rows = rows.unionByName(named.select("conv_id", *empty, F.lit(False).alias("said")))
    order = ["conv_id", F.asc_nulls_first("said"), F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    fields = [("step", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), *[(c, T.StringType()) for c in EDITS[3:]]]
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in fields]])
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    return rows.mapInArrow(lambda b: _repair(b, arrow), schema)


class _Digest:
    """Running figures of one conversation's edits."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.audit, self.text = conv_id, bytearray(), hashlib.sha256()
        self.counts, self.illegal, self.cost, self.turns = dict.fromkeys(FAULTS, 0), 0, 0, 0
        self.least = self.most = self.before = None
        self.written = False

    def add(self, edit: str, turn: int | None, role: str | None, text: str, new_role: str | None, fault: str | None) -> None:
        self.audit += edit.encode()
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            if turn is not None and turn != self.most:
                self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if edit != "D":
            self.text.update(f"{chr(10) * self.written}{new_role}:{text}".encode())
            self.written = True

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *[self.counts[f] for f in FAULTS], self.illegal, self.cost, self.audit.decode(), self.text.hexdigest())


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digest(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    open_: _Digest | None = None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["conv_id", *FIGURES, "audit", "repaired_sha256"])

    for batch in batches:
        done = []
        for conv_id, step, *edit in zip(*[column_of(batch, c).to_pylist() for c in ("conv_id", "step", "edit", "turn", "role", "text", "new_role", "fault")], strict=True):
            if step is None or step == 0:
                if open_ is not None:
                    done.append(open_.row())
                open_ = _Digest(conv_id)
            if step is not None:
                open_.add(*edit)
        yield rows(done)
    if open_ is not None:
        yield rows([open_.row()])


def digest_repairs(edits: DataFrame) -> DataFrame:
    """One row per conversation, read from `repair_conversations` as it streams by (its rows must still be in its order).

    conv_id, gaps (missing turn numbers between the first and the last), blank, duplicate, truncated (turns with this first
    fault), illegal (neighbours whose role initials are none of su, ua, au), cost, audit (the edits), repaired_sha256 (of
    the repaired turns `role:text`, joined by line breaks). Conversations without turns have zeros and empty texts.
    """
    kind = edits.schema["conv_id"].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    fields = [*[(f, T.LongType()) for f in FIGURES], ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in fields]])
    return edits.mapInArrow(lambda b: _digest(b, arrow), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Damage by crc32(`conv_id:turn`) % 20, nulls as one space: 0 drops, 1 empties, 2 takes stops away, 3 repeats, 4 rerolls."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.encode(F.concat(said[0], F.lit(":"), said[1]), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], way.alias("_way"))
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_way") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_way") == 3, 2).otherwise(1)
    return rows.where("_way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_time")).drop("_time")
