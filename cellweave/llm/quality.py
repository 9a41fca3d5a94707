"""Quality classifier: heuristic labellers weighed by expectation-maximisation teach a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of

# Shapes of bytes: letters, capitals, digits, blanks, line breaks, sentence marks, brackets and quotes, other marks.
LETTER, UPPER, DIGIT, BLANK, BREAK, STOP, QUOTE, MARK, PIPE, SHOUT = range(10)


def _shapes() -> np.ndarray:
    table = np.full(256, LETTER, dtype=np.uint8)
    for shape, chars in ((BLANK, " \t\r"), (BREAK, "\n"), (STOP, ".,;:?-"), (QUOTE, "'\"()"), (PIPE, "|"), (SHOUT, "!")):
        table[[ord(c) for c in chars]] = shape
    for code in range(33, 127):
        c = chr(code)
        if c.isdigit():
            table[code] = DIGIT
        elif c.isupper():
            table[code] = UPPER
        elif not c.isalpha() and table[code] == LETTER:
            table[code] = MARK
    table[:9] = table[14:32] = MARK
    return table


SHAPES = _shapes()
SPAN = 60  # words of a stretch in which repetition is measured
LABELLERS = ("variety", "stutter", "marks", "capitals", "tables", "word_length", "lines", "shouting", "prose", "breaks")


@dataclass(frozen=True)
class Measures:
    """Figures of one text that the labellers look at."""

    words: int
    variety: float  # different words in a stretch, by its words, mean
    stutter: float  # words equal to the one before
    marks: float  # odd marks a word
    capitals: float  # capitals among ASCII letters and other letter bytes
    pipes: float  # bars a word
    sentences: float  # lines that end with a sentence mark
    length: float  # bytes of a word, mean
    lines: float  # lines that repeat an earlier one
    shouting: float  # exclamation marks a word


def measure(text: str) -> tuple[Measures, np.ndarray]:
    """Figures of a text, and the shape of each of its bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shape = SHAPES[data]
    counts = np.bincount(shape, minlength=10)
    found = text.split()
    n = len(found)
    if not n:
        return Measures(0, 0, 0, 0, 0, 0, 0, 0, 0, 0), shape
    stretches = [found[i : i + SPAN] for i in range(0, max(1, n - SPAN // 2), SPAN)]
    variety = sum(len(set(s)) for s in stretches) / sum(map(len, stretches))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    long = [s for s in lines if len(s) > 10]
    letters = counts[LETTER] + counts[UPPER]
    return (
        Measures(
            n,
            variety,
            sum(map(eq, found, found[1:])) / n,
            counts[MARK] / n,
            counts[UPPER] / max(letters, 1),
            counts[PIPE] / n,
            sum(s[-1] in ".?!\"'):;" for s in lines) / len(lines),
            (len(data) - counts[BLANK] - counts[BREAK]) / n,
            1 - len(set(long)) / max(len(long), 1),
            counts[SHOUT] / n,
        ),
        shape,
    )


def votes(m: Measures) -> tuple[int, ...]:
    """Each labeller's vote: 2 for, 0 against, 1 no opinion.

    Most labellers know one fault: they vote against a text that has it and for one that has not. `prose` and
    `breaks` know what is usual instead, and have no opinion of short texts.
    """
    enough = m.words >= 15
    against = lambda fault: 0 if fault else 2
    usual = lambda good: (2 if good else 0) if enough else 1
    return (
        against(enough and m.variety < 0.42),
        against(m.words > 3 and m.stutter > 0.07),
        against(m.marks > 0.1),
        against(enough and m.capitals > 0.3),
        against(m.pipes > 0.04),
        against(m.length > 14 or m.length < 2),
        against(enough and m.lines > 0.5),
        against(m.shouting > 0.12),
        usual(m.variety > 0.5 and m.stutter < 0.05 and m.capitals < 0.2 and max(m.marks, m.pipes, m.shouting) < 0.05),
        usual(m.sentences > 0.5),
    )


def code_of(given: tuple[int, ...]) -> int:
    out = 0
    for v in given:
        out = out * 3 + v
    return out


def decode(code: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([code // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1)


@dataclass(frozen=True)
class LabelModel:
    """P(good) and, for each labeller, P(vote | class): shape (labellers, 2, 3)."""

    prior: float
    tables: np.ndarray

    def posterior(self, given: np.ndarray) -> np.ndarray:
        """P(good | votes), votes of shape (rows, labellers). A labeller without an opinion says nothing."""
        k = np.arange(given.shape[1])
        said = given != 1
        bad = (np.log(self.tables[k, 0, given]) * said).sum(axis=1) + np.log1p(-self.prior)
        good = (np.log(self.tables[k, 1, given]) * said).sum(axis=1) + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right where it has an opinion."""
        right = self.prior * self.tables[:, 1, 2] + (1 - self.prior) * self.tables[:, 0, 0]
        wrong = self.prior * self.tables[:, 1, 0] + (1 - self.prior) * self.tables[:, 0, 2]
        return right / np.maximum(right + wrong, 1e-12)


def fit_labels(given: np.ndarray, times: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over patterns of votes and how often each occurs.

    Starts from the rule that one bad vote makes a text doubtful (most bad texts fail a single check);
    one smoothing count for each vote, so no labeller is ever certain.
    """
    n = given.shape[1]
    p = np.where((given == 0).any(axis=1), 0.02, 0.98)
    model = LabelModel(0.5, np.full((n, 2, 3), 1 / 3))
    for _ in range(rounds):
        tables = np.empty((n, 2, 3))
        for v in range(3):
            hit = given == v
            tables[:, 1, v] = (hit * (times * p)[:, None]).sum(axis=0)
            tables[:, 0, v] = (hit * (times * (1 - p))[:, None]).sum(axis=0)
        tables += 1
        tables /= tables.sum(axis=2, keepdims=True)
        prior = float(np.clip((times * p).sum() / max(times.sum(), 1), 0.01, 0.99))
        model = LabelModel(prior, tables)
        new = model.posterior(given)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def hashed(m: Measures, shape: np.ndarray, dims: int) -> np.ndarray:
    """Hashed features: byte-shape trigrams and 5-grams by root frequency, and steps of the figures."""
    out = np.zeros(dims, dtype=np.float32)
    if len(shape):
        s = shape.astype(np.uint32)
        for n, odd in ((3, 2654435761), (5, 2246822519)):
            if len(s) < n:
                continue
            h = np.zeros(len(s) - n + 1, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(11) + s[k : len(s) - n + 1 + k]
            h = (h * np.uint32(odd)) >> np.uint32(16)
            out += np.sqrt(np.bincount(h % dims, minlength=dims) / len(h)).astype(np.float32)
    if m.words >= 15:
        for k, (value, width) in enumerate(((m.variety, 0.1), (m.stutter, 0.05), (m.marks, 0.1), (m.capitals, 0.1), (m.pipes, 0.1), (m.sentences, 0.25), (m.lines, 0.2), (m.shouting, 0.2))):
            step = min(int(value / width), 9)
            out[(k * 10 + step + 1) * 40503 % 65536 % dims] += 0.5
    return out


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -60, 60))))


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh the same."""
    n, dims = x.shape
    if not n:
        return np.zeros(dims, dtype=np.float32), 0.0
    good, bad = max(p.sum(), 1e-6), max((1 - p).sum(), 1e-6)
    a, b = (p / good / 2).astype(np.float32), ((1 - p) / bad / 2).astype(np.float32)
    w, c = np.zeros(dims, dtype=np.float32), 0.0
    w0, c0 = w, c
    rate = 4.0 / (float((x * x).sum(axis=1).max(initial=0)) + 1)
    for step in range(rounds):
        look = step / (step + 3)
        v, d = w + look * (w - w0), c + look * (c - c0)
        q = 1 / (1 + np.exp(-np.clip(x @ v + d, -30, 30)))
        g = a * (q - 1) + b * q
        w0, c0 = w, c
        w, c = v - rate * (x.T @ g + ridge * v), d - rate * float(g.sum())
    return w, float(c)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [code_of(votes(measure(t)[0])) for t in column_of(batch, "text").to_pylist() if t and not t.isspace()]
        found, times = np.unique(np.array(codes, dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["code", "times"])


def _examples(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, rows = [], []
        for text in column_of(batch, "text").to_pylist():
            m, shape = measure(text or "")
            if m.words:
                codes.append(code_of(votes(m)))
                rows.append(hashed(m, shape, dims).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(rows, pa.binary())], ["code", "features"])


def fit_quality(docs: DataFrame, fit_rows: int = 8000, dims: int = 1024) -> QualityModel:
    """Fit the label model on the votes over all documents, then the scorer on a bounded sample.

    The votes of all documents are counted by pattern (at most 3 ** labellers of them) and only these counts
    reach the driver. About `fit_rows` documents, chosen by a hash, give the scorer's examples: hashed features
    of `dims` numbers with the label model's posterior as soft label. Null and blank texts are left out.
    An empty table gives a scorer that says 0.5.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = docs.select("text").mapInArrow(_patterns, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).collect()
    counts = sorted((r["code"], r["times"]) for r in counts)
    given = decode(np.array([c for c, _ in counts], dtype=np.int64))
    times = np.array([n for _, n in counts], dtype=np.float64)
    labels = fit_labels(given, times)
    share = min(1.0, fit_rows / max(times.sum(), 1))
    part = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = part.select("text").mapInArrow(lambda b: _examples(b, dims), "code long, features binary").toArrow()
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), dtype=np.float32).reshape(-1, dims)
    p = labels.posterior(decode(rows["code"].to_numpy())) if len(x) else np.zeros(0)
    return QualityModel(labels, *fit_linear(x, p))


NEW = (("quality_posterior", T.DoubleType()), ("quality_score", T.DoubleType()), ("quality_keep", T.BooleanType()))


def _judge(batches: Iterator[pa.RecordBatch], model: QualityModel, threshold: float, columns: list[str]) -> Iterator[pa.RecordBatch]:
    dims = len(model.weights)
    for batch in batches:
        codes, scores = [], []
        for text in column_of(batch, "text").to_pylist():
            m, shape = measure(text or "")
            codes.append(code_of(votes(m)) if m.words else -1)
            scores.append(model.score(hashed(m, shape, dims)) if m.words else 0.0)
        code, score = np.array(codes, dtype=np.int64), np.array(scores)
        found = np.where(code < 0, 0.0, model.labels.posterior(decode(np.maximum(code, 0))))
        arrays = [column_of(batch, c) for c in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(found), pa.array(score), pa.array(score >= threshold)], [*columns, *[n for n, _ in NEW]])


def classify_quality(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.2) -> DataFrame:
    """Add quality_posterior (label model), quality_score (linear scorer) and quality_keep (score >= threshold).

    The threshold is low because a good text lost costs more here than a doubtful one kept.

    Every row and column of `docs` stays; input columns with the new names are replaced. Without a model one is
    fitted on `docs`. Null, empty and blank texts score 0 and are not kept. Repeated rows get equal scores.
    """
    model = fit_quality(docs) if model is None else model
    names = {n for n, _ in NEW}
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in NEW]])
    columns = docs.columns
    return docs.mapInArrow(lambda b: _judge(b, model, threshold, columns), schema)
