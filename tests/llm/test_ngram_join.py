"""Components against all pairs; buckets and groups in blocks; the trie alone; odd tables."""

import random
import re

import numpy as np
import pytest

from auditlens.llm import ngram_join, ngram_trie, queries
from auditlens.llm.components import components
from tests.conftest import SF


def gram_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(texts, percent=90):
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    sets = {i: gram_set(t) for i, t in texts.items()}
    ids = sorted(sets, key=lambda i: (len(sets[i]), i))
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def check(rows, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts) and len(rows) == len(texts)


@pytest.fixture(scope="module")
def noisy():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice((40, 80, 300, 2500)))] for _ in range(6)]
    line = [r.choice(vocab) for _ in range(25)]
    texts = {}
    for i in range(260):
        w = list(r.choice(base)) if r.random() < 0.8 else [r.choice(vocab) for _ in range(120)] + line
        for _ in range(r.randint(0, max(1, len(w) // 50))):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts[i * 3] = " ".join(w).upper() if i % 5 == 0 else " ".join(w)
    return texts | {1: None, 2: "", 4: " \n", 5: "a", 7: "A", 8: "a b", 10: "a b c", 11: "é a", 13: "a\x0bb"}


def test_against_all_pairs(spark, noisy):
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in noisy.items()] + [(5, "a", "m", 1)], "doc_id long, text string, id string, n int")
    check(ngram_join.ngram_components(df).collect(), noisy)
    kept = ngram_join.one_per_component(df.where("id = 'n'"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(noisy).values()})


def test_in_blocks(spark, noisy, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    df = spark.createDataFrame(list(noisy.items()), "doc_id long, text string")
    check(ngram_join.ngram_components(df).collect(), noisy)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    check(queries.QUERIES["op6_ngram_join"](spark, SF).collect(), dict(zip(docs.doc_id, docs.text)))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "x y z"), (3, "x y z"), (None, "p")], "doc_id long, text string")
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(df).collect()} == {(None, 3), (3, 3)}


@pytest.mark.parametrize("seed", range(40))
def test_trie(seed):
    r = random.Random(seed)
    base = [r.sample(range(300), r.randint(1, 60)) for _ in range(3)]
    sets = []
    for _ in range(r.randint(2, 40)):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 6)):
            s ^= {r.randint(0, 400)}
        sets.append(np.array(sorted(s or {0}), np.uint64))
    half = r.randint(1, len(sets) - 1) if seed % 2 else None
    found = ngram_trie.spanning_links(sets, None, 85) if half is None else ngram_trie.spanning_links(sets[:half], sets[half:], 85)
    got, want = ngram_trie.Links(len(sets)), ngram_trie.Links(len(sets))
    like = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    for a, b in found:
        assert like(a, b) and got.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if (half is None or (a < half) != (b < half)) and like(a, b):
                want.join(a, b)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(20, 60)] + [(7, 7), (None, 3), (2, 1), (1, 2)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 181)) and all(out[i] == 5 for i in range(20, 60)) and out[1] == out[2] == 1 and 7 not in out
