"""Links, components and recall of lattice hashing against all cosines; the lattice itself; odd tables."""

import itertools

import numpy as np
import pytest

from auditlens.llm import near_vectors
from auditlens.llm.common import table
from auditlens.llm.lattice import Tables, nearest, shortest
from tests.conftest import SF


def plain(rows, cosine):
    """{id: (links, smallest reachable)} by all cosines."""
    ids = list(rows)
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows.items()
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in unit if j != i and i in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        out[i] = (len(links[i]), min(seen))
    return out


def test_nearest_points():
    rng = np.random.default_rng(5)
    assert len(shortest()) == 240 and np.allclose((shortest() ** 2).sum(1), 2) and len(np.unique(shortest(), axis=0)) == 240
    assert (nearest(shortest()) == shortest()).all()
    x = rng.normal(size=(300, 8)) * 3
    home = nearest(x)
    distance = ((x - home) ** 2).sum(1)
    assert distance.max() <= 1 + 1e-9 and (np.abs(2 * home - np.rint(2 * home)) < 1e-9).all() and (home.sum(1) % 2 == 0).all()
    for step in shortest():
        assert (distance <= ((x - home - step) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("dims", [64, 20, 5])
def test_recall_at_the_least_cosine(dims):
    """Pairs of exactly the least cosine share a cell, one of them at home, about as often as asked for."""
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(1500, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for rows in (1_000, 1_000_000):
        tables = Tables(dims, rows, 0.9, 0.99)
        x, y = tables.cells(a), tables.cells(b)
        met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1)
        assert met.mean() >= 0.97, (rows, met.mean())
        assert len({tuple(c) for c in x[0].tolist()}) == tables.count


@pytest.mark.parametrize("block,small", [(2048, 32), (40, 4)])
def test_same_as_all_cosines(spark, monkeypatch, block, small):
    """Groups near and wide, copies, chains; also where cells are cut into blocks. Nearly all links, none that is no link."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "SMALL", small)
    rng = np.random.default_rng(7)
    rows = {i: rng.normal(size=24).tolist() for i in range(300)}
    base = rng.normal(size=24)
    for i in range(300, 440):  # one group of near copies
        rows[i] = (base + rng.normal(size=24) * 0.05).tolist()
    for i in range(440, 520):  # exact copies of one of them
        rows[i] = rows[310]
    turn = rng.normal(size=(2, 24))
    for i in range(520, 560):  # a chain
        rows[i] = (np.cos(i * 0.15) * turn[0] + np.sin(i * 0.15) * turn[1]).tolist()
    got = {r.vec_id: r for r in near_vectors.vector_components(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).collect()}
    want = plain(rows, 0.9)
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert got.keys() == want.keys() and all(got[i].n_links <= n for i, (n, _) in want.items()) and found >= 0.99 * true
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(got[i].n_links == want[i][0] for i in range(300, 520)) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_given_table(spark):
    rows = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.vector_components(table(spark, SF, "embeddings"), cosine=0.4).collect()}
    want = plain(rows, 0.4)
    assert all(got[i][0] <= want[i][0] for i in rows) and sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values()) > 0


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, cell long, v string, n int"
    one, two = [1.0, 2.0, 3.0], [1.0, 2.1, 3.0]
    vectors = [one, two, None, [], [0.0, 0.0, 0.0], [1.0, None, 3.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    data = [(i, v, 1, "x", 5, None, None) for i, v in enumerate(vectors)]
    data += [(None, one, 2, None, None, None, None), (20, one, 1, "a", 1, "b", 1), (20, one, 1, "a", 1, "b", 1), (20, [0.5, 0.0, 9.0], 1, "a", 1, "b", 1)]
    df = spark.createDataFrame(data, schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.vector_components(df).collect()}
    alone = {i: (0, i, True) for i in range(2, 9)}
    assert got == {**alone, 0: (3, 0, True), 1: (3, 0, False), None: (3, 0, False), 20: (3, 0, False), 9: (1, 9, True), 10: (1, 9, False)}
    empty = near_vectors.vector_components(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "class_id", "n_links", "component_id", "kept"]
    assert near_vectors.vector_components(df.where("vec_id = 4")).first()[2:] == (0, 4, True)
    big = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in near_vectors.vector_components(big).collect()} == {1: 1, 2: 1, 3: 0}
    assert list(itertools.chain(*near_vectors.vector_components(df.where("vec_id = 3")).select("n_links").collect())) == [0]
