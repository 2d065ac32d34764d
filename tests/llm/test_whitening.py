"""Covariances, deviations and projections against plain arithmetic; degenerate and odd tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from auditlens.llm import queries, whitening
from auditlens.llm.common import table
from tests.conftest import SF


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def check(rows, got, width):
    """Against whole-number covariances and numpy's eigenvectors of them."""
    x = [whole(v) for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    z = [[n * a - s for a, s in zip(r, sums)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n ** 3)) for j in range(dims)] for i in range(dims)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * width and {len(v) for v in by_row.values()} == {width}
    assert all(r.n == n and r.identity_error <= 1e-4 for r in got)
    for (i, _), zr in zip(rows, z):
        assert {r.deviation for r in by_row[i].values()} == {sum(a * a for a in zr)}
    for k in range(width):
        assert all(by_row[i][k + 1].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-6) for i, _ in rows)
        want = np.array([np.array(zr) / n @ axes[:, k] for zr in z]) / math.sqrt(values[k])
        have = np.array([by_row[i][k + 1].whitened for i, _ in rows])
        assert np.allclose(have, want * np.sign(have @ want), rtol=1e-6, atol=1e-7)


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    df = queries.QUERIES["op13_whitening"](spark, SF)
    check(rows, df.collect(), 32)


@pytest.mark.parametrize("size", [1.0, 1e7])
def test_correlated_and_large(spark, size):
    """Beyond 64 bits sums stay exact; whatever the partitions."""
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) * size + 5 * size
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = whitening.whiten(df, components=4).collect()
    if size == 1.0:
        check(rows, got, 4)
        return
    x = np.array([whole(v) for _, v in rows], object)
    z = 60 * x - x.sum(0)
    want = [int(sum(a * a for a in r)) for r in z]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 1 << 63 else None) for i, d in enumerate(want)}
    assert all(r.identity_error <= 1e-4 for r in got)


def test_pair_sums():
    y = np.array([[1, -2, 3], [4, 5, -6]])
    got = [p.tolist() for p in whitening.polarised(y)]
    assert got == [[17, 1 + 81, 16 + 4], [29, 1 + 1], [45]]
    far = np.array([[1 << 45, 1 << 45]] * 3)
    assert whitening.polarised(far)[0].tolist() == [3 << 90, 3 << 92]


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, v int, component string"
    keep = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25])]
    drop = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("-inf"), 1.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "a", None, "b") for r in keep + drop], schema)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4} and sorted({r.component for r in rows}) == [1, 2]
    assert {r.vec_id for r in rows} == {1, 2, None} and all(r.identity_error < 1e-6 for r in rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 5")).count() == 0
    same = whitening.whiten(df.where("vec_id = 2")).collect()  # no variance at all
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, 0.0, None)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(r.identity_error < 1e-9 for r in got)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e308, 2.0]), (3, [0.0, 3.5])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).count() == 6
