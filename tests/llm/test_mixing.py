"""Targets, words taken and the SQL form; odd tables."""

import re
from collections import defaultdict

import duckdb
import pytest

from auditlens.llm import mixing, queries
from tests.conftest import SF


def rows_of(con, sql, cols):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES["op1_mix"](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == rows_of(con, queries.ORACLE["op1_mix"], df.columns) and got


def targets(sizes):
    """Reshare by rounds, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for f in free for s in [f]}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("counts", [{"a": 500, "b": 3, "c": 40, None: 10, "😀": 100, "ￃ": 1}, {"a": 1}, {"x": 2, "y": 2}])
def test_targets_and_words_taken(spark, counts):
    docs = [(i * 31 + k, "w " * ((i * 7919) % 97 + (i % 50 == 0) * 900), s) for k, s in enumerate(counts) for i in range(counts[s] * 8)]
    docs += [(-1, None, "a" if "a" in counts else "x"), (-2, " \t\n", "empty"), (5, "one two", list(counts)[0]), (5, "one two", list(counts)[0])]
    df = spark.createDataFrame([(*d, 9, 9.0) for d in docs], "doc_id long, text string, source string, size long, target double")
    for piece in (20_000, 50):
        rows = mixing.mix_plan(df, piece=piece).collect()
        assert len(rows) == len(docs)
        sizes, taken = defaultdict(int), defaultdict(int)
        for _, text, s in docs:
            sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want = targets(sizes)
        for r in rows:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(2 * largest[s], 0.03 * want[s]), (s, taken[s], want[s])
        assert sorted(map(tuple, mixing.mix_plan(df, piece=piece).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_empty_and_emitted(spark):
    df = spark.createDataFrame([(1, "a b", "s", "k"), (2, "c", None, None)], "doc_id long, text string, source string, copies string")
    assert mixing.mix_plan(df.limit(0)).count() == 0
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(df).collect()}
    out = mixing.emit(df).collect()
    assert {i: sum(r.doc_id == i for r in out) for i in plan} == plan and mixing.emit(df).columns == df.columns
