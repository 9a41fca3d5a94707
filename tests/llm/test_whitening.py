import math

import numpy as np
import pytest

from cellweave.llm.whitening import Covariance, leading, whiten, whole_numbers
from cellweave.session import stored


def by_numpy(rows, count):
    """Rows (vec_id, vector) -> n, sums, eigenvalues, eigenvectors and trace of the distinct whole-number vectors."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    return x, n, sums, values[::-1][:count], vectors[:, ::-1][:, :count], float(np.trace(cov))


def same_up_to_sign(a, b, tolerance):
    return min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance


@pytest.mark.parametrize(("d", "rows"), [(40, 700), (5, 60)])
def test_whiten_equals_numpy(spark, d, rows):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(c)) for c in rng.standard_normal(d) * np.linspace(2, 0.2, d)]) for i in range(rows)]
    data += [(rows + i, data[0][1]) for i in range(200)]  # many copies of one vector count once
    odd = [(None, data[1][1]), (-1, None), (-2, [float("nan")] * d), (-3, [None] * d), (-4, [math.inf] * d), (-5, [1.0]), (-6, [])]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in data + odd], "vec_id long, embedding array<float>, x string, component int")
    count = min(16, d)
    x, n, sums, values, vectors, trace = by_numpy(data, count)
    got = whiten(table).collect()
    assert len(got) == (len(data) + 1) * count and len({(r["vec_id"], r["component"]) for r in got}) == len(got)
    assert {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1
    found = np.zeros((len(data), count))
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-9
        if r["vec_id"] is not None:
            found[r["vec_id"], r["component"] - 1] = r["whitened"]
            assert r["deviation"] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[r["vec_id"]], sums, strict=True))
    want = ((n * x - sums) / n) @ vectors / np.sqrt(values)
    for k in range(count):
        assert same_up_to_sign(found[:, k], want[:, k], 1e-6)


def test_flat_spectrum_is_certified_in_few_passes(spark):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(-64, 64, (3000, 64)), axis=0)
    fit = stored(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(3), "test-fit")
    cov = Covariance(fit, len(x), x.sum(axis=0))
    found = leading(cov, 16)
    c = (len(x) * x - x.sum(axis=0)) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert np.abs(found.values / values[::-1][:16] - 1).max() < 1e-12
    assert found.residuals.max() < 1e-11 * found.values[0] and found.passes < 120
    for k in range(16):
        assert same_up_to_sign(found.vectors[:, k], vectors[:, 63 - k], 1e-8)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 0.0]), (1, [0.5, 0.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0])], schema)).collect()
    first = {r["vec_id"]: r["whitened"] for r in line if r["component"] == 1}
    assert first[1] == first[3] == pytest.approx(-first[2]) and abs(first[1]) == pytest.approx(1.0)
    assert all(r["whitened"] is None for r in line if r["component"] > 1)
    far = whole_numbers(spark.createDataFrame([(1, [1e300, -1e300])], schema)).first()["x"]
    assert far == [2**40 + 1_000_000, -(2**40) + 1_000_000]
