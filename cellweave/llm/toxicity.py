"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the earlier ones."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import column_of, words

KNOWN_WORDS = 200_000  # words whose features a task keeps


class Hashed:
    """Hashed presence features of a text: its different words, and their first four and five letters."""

    def __init__(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out: set[int] = set()
        for w in set(words(text)):
            found = known.get(w)
            if found is None:
                parts = {"=" + w, *(w[:n] for n in (4, 5) if len(w) > n)}
                found = tuple(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) & self.mask for p in parts)
                known[w] = found
            out.update(found)
        return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


@dataclass(frozen=True)
class Linear:
    """Weights of the chosen hashed features, of the earlier probabilities, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def score(self, present: np.ndarray, earlier: np.ndarray) -> float:
        at = np.searchsorted(self.features, present)
        inside = at < len(self.features)
        hit = at[inside][self.features[at[inside]] == present[inside]]
        z = self.weights[hit].sum() + (self.chain @ earlier if len(self.chain) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Rows:
    """Presence features of many texts, end to end."""

    def __init__(self, found: Sequence[np.ndarray]) -> None:
        self.n = len(found)
        self.at = np.repeat(np.arange(self.n), [len(f) for f in found])
        self.feature = np.concatenate(found) if self.n else np.zeros(0, dtype=np.int32)


def fit_linear(rows: Rows, use: np.ndarray, y: np.ndarray, earlier: np.ndarray, bits: int, top: int = 384, rounds: int = 12, ridge: float = 0.3) -> Linear:
    """Logistic regression by Newton steps on the rows in `use`, over the `top` features that tell the classes apart best.

    A feature's worth is the log ratio of its (smoothed) shares in both classes times the root of its rows in
    the rarer class. Ridge keeps the weights of rare features small.
    """
    y = y.astype(np.float64)
    mine = use[rows.at]
    feature, at = rows.feature[mine], rows.at[mine]
    n1, n0 = max((y * use).sum(), 1), max(((1 - y) * use).sum(), 1)
    size = 1 << bits
    c1 = np.bincount(feature, weights=y[at], minlength=size)
    c0 = np.bincount(feature, minlength=size) - c1
    ratio = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    worth = np.abs(ratio) * np.sqrt(c1 + c0 * n1 / n0)
    worth[(c1 + c0) < 3] = 0
    chosen = np.sort(np.argsort(-worth, kind="stable")[:top])
    chosen = chosen[worth[chosen] > 0].astype(np.int32)
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    k, m = earlier.shape[1], len(chosen)
    lines = np.flatnonzero(use)
    line = np.full(rows.n, -1)
    line[lines] = np.arange(len(lines))
    x = np.zeros((len(lines), m + k + 1), dtype=np.float32)
    col = place[feature]
    x[line[at[col >= 0]], col[col >= 0]] = 1
    x[:, m : m + k] = earlier[lines]
    x[:, -1] = 1
    target, w = y[lines], np.zeros(m + k + 1)
    keep = np.full(m + k + 1, ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
        step = np.linalg.solve((x.T @ (x * h[:, None])).astype(np.float64) + np.diag(keep), x.T @ (p - target) + keep * w)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(chosen, w[:m], w[m : m + k], float(w[-1]))


@dataclass(frozen=True)
class Chain:
    """Categories in order, their models, and the hashing they share."""

    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    bits: int

    def predict(self, present: np.ndarray) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(model.score(present, np.array(out)))
        return out


def train_chain(found: Sequence[np.ndarray], labels: np.ndarray, fold: np.ndarray, categories: Sequence[str], bits: int) -> tuple[Chain, np.ndarray]:
    """Fit the chain; returns it and the out-of-fold probabilities of every row and category.

    Later models are trained on out-of-fold predictions of the earlier categories, as unsure as those they will
    see on new texts, never on predictions for rows that the earlier model was fitted on.
    """
    rows = Rows(found)
    earlier = np.zeros((rows.n, 0))
    models = []
    for c in range(len(categories)):
        y = labels[:, c]
        held = np.zeros(rows.n)
        for f in np.unique(fold):
            model = fit_linear(rows, fold != f, y, earlier, bits)
            for r in np.flatnonzero(fold == f):
                held[r] = model.score(found[r], earlier[r])
        models.append(fit_linear(rows, np.ones(rows.n, dtype=bool), y, earlier, bits))
        earlier = np.column_stack([earlier, held])
    return Chain(tuple(categories), tuple(models), bits), earlier


def _features(batches: Iterator[pa.RecordBatch], bits: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    hashed = Hashed(bits)
    for batch in batches:
        found = [hashed(t or "").tobytes() for t in column_of(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in columns], pa.array(found, pa.binary())], [*columns, "features"])


def fit_chain(
    docs: DataFrame, labels: DataFrame, given: Sequence[str], categories: Mapping[str, Column], fit_rows: int = 12_000, folds: int = 4, bits: int = 18
) -> tuple[Chain, np.ndarray, np.ndarray]:
    """Fit a chain on labelled documents: `labels` has doc_id and the 0/1 columns `given`.

    `categories` gives each category, in chain order, as a condition on the given labels and `text`.
    Repeated labels of a document count as 1 if any is; rows without doc_id or with a null label are left out.
    At most about `fit_rows` labelled documents are used, chosen by a hash of doc_id: this bounds what is broadcast
    and what the driver holds. Folds are by doc_id. Returns the chain, the out-of-fold probabilities and the
    labels of the rows used.
    """
    known = labels.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in given]).where("doc_id is not null")
    for c in given:
        known = known.where(F.col(c).isNotNull())
    known = known.withColumnRenamed("doc_id", "l_id")
    share = min(1.0, fit_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64(F.lit(9), "l_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
    names = list(categories)
    rows = texts.select("l_id", *[c.cast("int").alias(n) for n, c in categories.items()], "text")
    shape = T.StructType([*[rows.schema[c] for c in ("l_id", *names)], T.StructField("features", T.BinaryType())])
    rows = rows.mapInArrow(lambda b: _features(b, bits, ["l_id", *names]), shape)
    rows = rows.dropDuplicates(["l_id"]).withColumn("fold", F.pmod(F.xxhash64(F.lit(4), "l_id"), F.lit(folds))).toArrow().sort_by("l_id")
    found = [np.frombuffer(b, dtype=np.int32) for b in rows["features"].to_pylist()]
    y = np.column_stack([rows[c].to_numpy() for c in names]) if len(found) else np.zeros((0, len(names)))
    chain, held = train_chain(found, y, rows["fold"].to_numpy(), names, bits)
    return chain, held, y


def _predict(batches: Iterator[pa.RecordBatch], chain: Chain, threshold: float) -> Iterator[pa.RecordBatch]:
    hashed = Hashed(chain.bits)
    for batch in batches:
        p = np.array([chain.predict(hashed(t or "")) for t in column_of(batch, "text").to_pylist()]).reshape(-1, len(chain.categories))
        yes = p >= threshold
        arrays = [column_of(batch, "doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in p.T], *[pa.array(np.ascontiguousarray(c)) for c in yes.T]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"p_{c}" for c in chain.categories], *chain.categories])


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """Probability `p_<category>` and decision `<category>` (>= threshold) of every category, in chain order.

    One row per row of `docs`, with doc_id. Null and empty texts are scored by the models' biases alone. Words are
    runs of letters and digits in lower case, whole texts. Other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories],
            *[T.StructField(c, T.BooleanType()) for c in chain.categories],
        ]
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _predict(b, chain, threshold), schema)
