import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm.multi_index import MultiIndex, layout, nearest
from cellweave.llm.pq_dedup import fit_codebooks, near_duplicates, probes
from cellweave.llm.vectors import cosines, distances, k_means

SCHEMA = "vec_id long, embedding array<float>, score double, n_links string"


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    x = (middle[rng.integers(0, 12, 400)] + 0.25 * rng.normal(size=(400, 16))).astype(np.float32)
    x[50:80] = x[50]  # many equal vectors
    x[90] = 3 * x[50]  # same direction, other length
    rows = [(i, v.tolist(), None, "clash") for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, None, "") for i, v in enumerate(odd)] + [(None, x[3].tolist(), None, ""), rows[7]]
    return spark.createDataFrame(rows, SCHEMA), x


def exact(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T


def test_nearest_against_all_pairs(vectors):
    df, x = vectors
    got = {}
    for r in nearest(df, F.col("vec_id") % 5 == 0, recall=0.97, asked_rows=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 5))
    cos, hit = exact(x), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert all(abs(cos[q, v] - s) < 1e-9 for _, v, s in found)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
        row = np.round(cos[q], 9)
        row[q] = -9
        hit += len(set(np.lexsort((np.arange(400), -row))[:5]) & {f[1] for f in found})
    assert hit / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[50]] == [51, 52, 53, 54, 55]


def test_nearest_with_repeated_rows_next_to_equal_vectors(spark):
    """Ten rows of one id hide neither the other ids of the same vector nor what lies beyond."""
    same, near, far = [1.0, 0.0, 0.2, 0.0], [1.0, 0.1, 0.2, 0.0], [0.0, 1.0, 0.0, 0.5]
    rows = [(1, same)] * 10 + [(i, same) for i in range(2, 7)] + [(7, near)] * 12 + [(8, far), (8, same), (9, far)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(1, 7, 9))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    cos = {(a, b): round(float(cosines(np.array([x]), np.array([y]))[0]), 6) for a, x in (("s", same), ("n", near), ("f", far)) for b, y in (("s", same), ("n", near), ("f", far))}
    assert found[1] == [(i, 1.0) for i in range(2, 7)]
    assert found[7] == [(i, cos["n", "s"]) for i in range(1, 6)]
    assert found[9][0] == (8, 1.0) and [v for v, _ in found[9][1:]] == [7, 1, 2, 3]


def test_small_tables(spark, vectors):
    df, _ = vectors
    few = df.where("vec_id < 3")
    assert [(r["query_id"], r["rank"]) for r in nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    for empty in (df.limit(0), df.where("vec_id >= 1000")):
        assert nearest(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert near_duplicates(df.limit(0)).count() == 0
    assert {(r["n_links"], r["kept"]) for r in near_duplicates(df.where("vec_id >= 1000")).collect()} == {(0, True)}


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    counts = rng.integers(0, 4, (6, 5))
    index = MultiIndex(left, right, counts, *layout(counts))
    u = rng.normal(size=6)
    sums = distances(u[None, :3], left)[0][:, None] + distances(u[None, 3:], right)[0][None, :]
    want = [c for _, c in heapq.nsmallest(30, ((s, c) for c, s in enumerate(sums.ravel()))) if counts.ravel()[c]]
    assert index.visit(u, 10**6) == want
    held = np.cumsum(counts.ravel()[want])
    assert len(index.visit(u, 12)) == int(np.searchsorted(held, 12)) + 1


def test_entries_needed_for_cells():
    rng = np.random.default_rng(8)
    counts = rng.integers(1, 4, (4, 4))
    index = MultiIndex(rng.normal(size=(4, 2)), rng.normal(size=(4, 2)), counts, *layout(counts))
    u = rng.normal(size=4)
    order = list(index.order(u))
    held = dict(zip([c for c, _ in order], np.cumsum([n for _, n in order]).tolist(), strict=True))
    assert index.needed(u, {order[2][0], order[7][0]}) == [held[order[2][0]], held[order[7][0]]]
    assert max(held.values()) == counts.sum()


def test_layout_splits_large_cells():
    shard, blocks = layout(np.array([[5, 10_000, 3], [0, 4, 2000]]))
    assert blocks.sum() >= 5 and len(set(shard[[0, 1]])) == 2


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_near_duplicates_against_all_pairs(vectors, threshold, monkeypatch):
    import cellweave.llm.pq_dedup as module

    monkeypatch.setattr(module, "BLOCK", 32)
    df, x = vectors
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, threshold, list_rows=40.0).collect()}
    ids = [*range(400), None, 7]
    cos = exact(np.vstack([x, x[3], x[7]]))
    linked = cos >= threshold
    np.fill_diagonal(linked, False)
    least = np.arange(402)
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], 10**6).min(axis=1))
        if (new == least).all():
            break
        least = new
    want = {(ids[i], int(linked[i].sum()), int(least[i]), ids[i] == least[i]) for i in range(402)}
    want |= {(1000 + i, 0, 1000 + i, True) for i in range(7)}
    assert got == want


def test_probes_miss_nothing():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(300, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    books = fit_codebooks(u, 12, 4, 8)
    own, _, far, _ = books.encode(u)
    radius = np.array([far[own == c].max(initial=0) for c in range(len(books.lists))])
    go = probes(u, own, books.lists, radius, 0.6)
    near = np.sqrt(distances(u, u)) <= 0.6
    a, b = np.nonzero(near)
    assert go[a, own[b]].all() and not go.all()


def test_helpers():
    a = np.array([[3.0, 4.0], [1e-200, 0.0]])
    assert np.allclose(cosines(a, np.array([[4.0, 3.0], [1e200, 0.0]])), [0.96, 1.0])
    assert len(k_means(np.ones((5, 2)), 3)) == 1 and len(k_means(np.zeros((0, 2)), 3)) == 1
