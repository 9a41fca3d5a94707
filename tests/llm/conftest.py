import random

import pytest

WORDS = ["amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "heath", "islet", "jetty", "knoll", "lagoon", "marsh", "oasis", "plain", "ridge"]
DOCS = "doc_id long, text string, source string, kept boolean, node long, n_tokens string"


def prose(n, seed, per_line=12):
    """Sentences of different words."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = rng.choice(WORDS) + rng.choice(WORDS)[:3] + str(rng.randrange(1000) if rng.random() < 0.05 else "")
        out.append(word + (".\n" if i % per_line == per_line - 1 else " "))
    return "".join(out).strip().capitalize()


@pytest.fixture
def documents(spark):
    """Documents with every odd case: nulls, empty and very long texts, repeated rows and ids, clashing columns."""

    def make(extra=()):
        base = prose(80, 1)
        rows = [
            (1, base),
            (2, base),  # exact copy
            (3, base.replace("amber", "amber", 1) + " tail"),  # near copy
            (4, prose(90, 2)),
            (4, prose(90, 2)),  # repeated row
            (4, prose(60, 3)),  # repeated id, other text
            (5, None),
            (6, ""),
            (7, " \n \n"),
            (None, prose(70, 4)),
            (None, prose(70, 4)),
            (8, prose(20_000, 5)),  # very long
            (9, "x" * 100_000),  # one very long word
            (10, "two words"),
            (11, "two words"),
            (12, "ünïcödé Straße — 漢字かな ﬁ 🙂 İstanbul ΟΔΟΣ e\u0301 <|endoftext|> <s> a,b. it's I'LL 3,14"),
            *extra,
        ]
        sources = ["a", "a", "a", "b", "b", None]
        data = [(i, t, sources[k % 6], None, k, "clash") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
