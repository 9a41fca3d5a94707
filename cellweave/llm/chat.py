"""Chat formatting: records of many layouts become canonical turns, chosen by a fingerprint of their paths."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of


@dataclass(frozen=True)
class Layout:
    """A declarative mapping from one record layout to turns.

    `turns` names the array of turns with the fields `role` and `text` inside it; `parts` names single
    fields in order, each with its role. Fields of equal role that follow each other are joined by a blank line.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    parts: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: Mapping[str, str] = field(default_factory=dict)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("messages", ("messages[]", "messages[].role", "messages[].content"), ("id",), turns="messages", roles=NAMES),
    Layout("conversations", ("conversations[]", "conversations[].from", "conversations[].value"), ("id",), turns="conversations", role="from", text="value", roles=NAMES),
    Layout("instruction", ("instruction", "output"), ("input", "system", "id"), parts=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("prompt", ("prompt", "response"), ("system", "id"), parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("completion", ("prompt", "completion"), ("system", "id"), parts=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Layout("question", ("question", "answer"), ("context", "id"), parts=(("context", "user"), ("question", "user"), ("answer", "assistant"))),
    Layout("nested", ("input", "input.prompt", "output", "output.text"), ("input.system", "id"), parts=(("input.system", "system"), ("input.prompt", "user"), ("output.text", "assistant"))),
)


def paths(record: object, prefix: str = "") -> set[str]:
    """Nested field paths; an array adds `[]`, whatever its length, and the paths of all its elements."""
    found: set[str] = set()
    if isinstance(record, dict):
        for key, value in record.items():
            here = f"{prefix}.{key}" if prefix else str(key)
            found |= {here} if not isinstance(value, list) else set()
            found |= paths(value, here)
    elif isinstance(record, list):
        found.add(f"{prefix}[]")
        for value in record:
            found |= paths(value, f"{prefix}[]")
    return found


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Every layout under the fingerprint of its required paths with each choice of optional ones."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, n):
                out.setdefault(fingerprint({*layout.required, *some}), layout)
        if layout.turns:  # an empty array of turns shows no inner paths
            out.setdefault(fingerprint({f"{layout.turns}[]"}), layout)
    return out


def _at(record: dict, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def canonical(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Turns of a record: (role, text), null texts empty, null roles `user`."""
    if layout.turns:
        found = [t for t in _at(record, layout.turns) or [] if isinstance(t, dict)]
        turns = [(t.get(layout.role), t.get(layout.text)) for t in found]
    else:
        turns = [(role, _at(record, path)) for path, role in layout.parts]
        turns = [t for t in turns if t[1] not in (None, "")]
    out: list[tuple[str, str]] = []
    for role, text in turns:
        role = "user" if role is None else str(role)
        role, text = layout.roles.get(role, role), "" if text is None else str(text)
        if not layout.turns and out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((role, text))
    return out


# Template: `### role: text</turn>\n` for each turn. A backslash in a role or text is doubled and one is put
# before whatever could start a control string, so taking away each backslash that leads a character undoes it.
HEAD, END = "### ", "</turn>\n"
_ESCAPE = re.compile(r"\\|#|</|:(?= )")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.|:(?! ))*+): ((?:[^\\<]++|\\.|<(?!/turn>\n))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation, and the spans (code points) of the texts that carry loss."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{HEAD}{escape(role)}: ", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _format(batches: Iterator[pa.RecordBatch], layouts: Sequence[Layout]) -> Iterator[pa.RecordBatch]:
    known = registry(layouts)
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        names, marks, turns, texts, spans = [], [], [], [], []
        for raw in column_of(batch, "record").to_pylist():
            try:
                record = json.loads(raw) if raw else None
            except ValueError:
                record = None
            mark = fingerprint(paths(record)) if isinstance(record, dict) else None
            layout = known.get(mark)
            if layout is None:
                text, place, found = None, None, None
            else:
                found = canonical(record, layout)
                text, place = render(found)
            names.append(layout.name if layout else None)
            marks.append(mark)
            turns.append(None if found is None else [{"role": r, "text": t} for r, t in found])
            texts.append(text)
            spans.append(None if place is None else [{"start": a, "stop": b} for a, b in place])
        yield pa.RecordBatch.from_arrays(
            [column_of(batch, "conv_id"), pa.array(marks, pa.string()), pa.array(names, pa.string()), pa.array(turns, pa.list_(turn)), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))],
            ["conv_id", "fingerprint", "layout", "turns", "formatted", "loss_spans"],
        )


def format_chats(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Turn JSON records (`conv_id`, `record`) of different layouts into canonical turns and training text.

    The sha256 of a record's sorted nested paths picks a declarative mapping from `layouts` (each is known
    under the fingerprints of all its optional fields). Returns one row per record: conv_id, fingerprint,
    layout, turns (role, text), formatted, loss_spans (code points [start, stop) of each assistant text).

    Unknown layouts, broken JSON and null records keep their row with null layout, turns, formatted and spans
    (fingerprint null only if there is no JSON object). Null texts are empty, null roles are `user`, an empty
    array of turns formats to the empty string. Repeated rows stay; other columns are ignored.
    """
    kind = records.schema["conv_id"].dataType
    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("conv_id", kind),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("layout", T.StringType()),
            T.StructField("turns", turn),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_spans", span),
        ]
    )
    return records.select("conv_id", F.col("record").cast("string").alias("record")).mapInArrow(lambda b: _format(b, layouts), schema)


def records_of_turns(turns: DataFrame) -> DataFrame:
    """One `messages` record per conversation from a table of turns (`conv_id`, `turn`, `role`, `text`).

    Turns are ordered by `turn`, ties by role and text; null turns come first. Repeated rows stay.
    """
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    ordered = F.sort_array(F.collect_list(said))
    messages = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def _digest(batches: Iterator[pa.RecordBatch], learn: str) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        n_turns, turns_sha, n_loss, loss_sha, chars = [], [], [], [], []
        for text, spans in zip(column_of(batch, "formatted").to_pylist(), column_of(batch, "loss_spans").to_pylist(), strict=True):
            if text is None:
                for values in (n_turns, turns_sha, n_loss, loss_sha, chars):
                    values.append(None)
                continue
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            n_turns.append(len(turns))
            turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
            n_loss.append(len(loss))
            loss_sha.append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
            chars.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [column_of(batch, "conv_id"), pa.array(n_turns, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(n_loss, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(chars, pa.int64())],
            names,
        )


def digest_chats(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """What can be read back from `format_chats`: turns, loss text and length of every conversation.

    Rows without a formatted text keep nulls.
    """
    kind = formatted.schema["conv_id"].dataType
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in fields]])
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(lambda b: _digest(b, learn), schema)
