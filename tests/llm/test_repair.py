import hashlib
import itertools
import random
import re
import zlib

import pytest

from cellweave.llm import repair
from cellweave.llm.queries import QUERIES
from cellweave.llm.repair import Conversation, Steps, damaged, digest_repairs, repair_conversations

STOPS = (".", "!", "?")
BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if not bare.endswith(STOPS) else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by trying every sequence of edits."""
    best = None

    def go(i, so_far, cost, audit, said):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", so_far):
            best = min(best, (cost, audit, said)) if best else (cost, audit, said)
        if len(audit) > 2 * len(rows) + 3 or not re.fullmatch("s?(ua)*u?", so_far):
            return
        for new in ("user", "assistant"):
            go(i, so_far + new[0], cost + 2, audit + "I", (*said, f"{new}:"))
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, so_far, cost + 3, audit + "D", said)
            if faults[i] not in ("blank", "duplicate"):
                left = faults[i] == "truncated"
                go(i + 1, so_far + (role[:1] or "-"), cost + left, audit + "K", (*said, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    go(i + 1, so_far + new[0], cost + 2 + left, audit + "R", (*said, f"{new}:{text}"))

    go(0, "", 0, "", ())
    return best


def figures(turns):
    """Sorted (turn, role, text) of one conversation -> the row that the operator should give."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    rows = [(r, t) for _, r, t in turns]
    faults = faults_of(rows)
    cost, audit, said = cheapest(rows, faults)
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def some_turns(seed, n, length):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for _ in range(rng.randrange(length + 1)):
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            out.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "", "unknown"]), rng.choice(["Yes.", "no", "So?", " \t", "", "a. ", "b\n!", " "])))
    return out


def test_repairs_equal_all_sequences_of_edits(spark):
    turns = some_turns(1, 60, 6)
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, first string")
    ids = spark.createDataFrame([(i,) for i in [*range(60), 60, None, 60]], "conv_id long")
    got = digest_repairs(repair_conversations(table, ids)).collect()
    assert sorted(r["conv_id"] for r in got if r["conv_id"] is not None) == list(range(61)) and len(got) == 62
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        mine = [t[1:] for t in turns if t[0] == r["conv_id"]]
        want = figures(mine) if mine else (0, 0, 0, 0, 0, 0, "", empty)
        assert tuple(r[c] for c in COLUMNS) == want, (r["conv_id"], mine)


def test_edits_are_the_repaired_turns(spark):
    table = spark.createDataFrame([("x", 4, "assistant", "a."), ("x", 1, "system", "s."), ("x", 1, "system", "s."), (None, None, None, None)], "conv_id string, turn int, role string, text string")
    rows = {}
    for r in repair_conversations(table).collect():
        rows.setdefault(r["conv_id"], []).append((r["step"], r["edit"], r["turn"], r["role"], r["text"], r["new_role"], r["fault"]))
    assert rows[None] == [(0, "D", None, " ", " ", None, "blank")]
    assert rows["x"] == [
        (0, "K", 1, "system", "s.", "system", None),
        (1, "D", 1, "system", "s.", None, "duplicate"),
        (2, "I", None, None, "", "user", None),
        (3, "K", 4, "assistant", "a.", "assistant", None),
    ]
    assert repair_conversations(table.limit(0)).count() == 0
    assert digest_repairs(repair_conversations(table.limit(0))).count() == 0


@pytest.mark.parametrize("held", [8 << 20, 300])
def test_giant_conversations_spill(monkeypatch, held):
    monkeypatch.setattr(repair, "HELD", held)
    rng = random.Random(2)
    turns = [(i, rng.choice(["user", "assistant"]), f"t{i}.") for i in range(3000)]
    talk = Conversation(1, Steps())
    for turn, role, text in turns:
        talk.hear(turn, role, text, role[:1], 0)
    assert (talk.waiting.parts > 0) == (talk.back.stored > 0) == (held == 300)
    edits = talk.edits().decode()
    cost = {0: 0}  # cheapest cost by state, without ties
    for _, role, _ in turns:
        step = {}
        for state, c in cost.items():
            for more, after, _ in repair._moves(state, role[0], 0):
                step[after] = min(step.get(after, 10**9), c + more)
        cost = step
    best = min(c + {0: 0, 1: 4, 2: 2, 3: 0}[s] for s, c in cost.items())
    assert sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in edits) == best
    rows = [r for part in talk.repaired() for r in part]
    assert "".join(r[2] for r in rows) == edits and [r[1] for r in rows] == list(range(len(edits)))
    assert re.fullmatch("(ua)+", "".join(r[6][0] for r in rows if r[6])) and [r[5] for r in rows if r[2] != "I"] == [t[2] for t in turns]


def test_damage_and_query_without_ties(spark, tmp_path):
    rng = random.Random(4)
    data = [(c, t, ("user", "assistant")[t % 2], f"Yes. No! {t}" if t % 3 else "what? now") for c in range(40) for t in range(rng.randrange(1, 6))]
    data += [(None, 0, None, None), (-1, None, "user", "x.")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    left, ids = {}, {d[0] for d in data}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        left.setdefault(conv, []).extend([(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1))
    assert damaged(table).count() == sum(map(len, left.values()))
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in got} == ids and len(got) == len(ids)
    for r in got:
        mine = left.get(r["conv_id"])
        want = figures(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(r[c] for c in COLUMNS) == want
