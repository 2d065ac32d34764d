"""Tiling against a plain version, planted passages whole, cut and reordered, odd tables."""

import random
import re

import numpy as np
import pytest

from auditlens.llm import decontamination, queries
from auditlens.llm.tiling import tiles
from tests.conftest import SF


def plain_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest unmarked match first, leftmost in b, then leftmost in a."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out, key=lambda t: (-t[2], t[1]))
        ma[i:i + n] = mb[j:j + n] = [True] * n
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles(seed):
    r = random.Random(seed)
    a = [r.randint(5, 5 + r.choice((2, 6, 30))) for _ in range(r.randint(0, 40))]
    b = [x for _ in range(3) for x in (a[r.randint(0, 20):][:r.randint(0, 25)] if r.random() < 0.7 else [r.randint(5, 9) for _ in range(9)])]
    got = tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    assert sorted(got, key=lambda t: (-t[2], t[1])) == plain_tiles(a, b, 3)


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, coverage):
    out = {}
    for d, text in docs.items():
        b = tokens(text)
        for i, item in bench.items():
            a = tokens(item)
            if len(a) >= 5 and set(zip(*(a[k:] for k in range(5)))) & set(zip(*(b[k:] for k in range(5)))):
                names = {w: n for n, w in enumerate(dict.fromkeys(a + b))}
                covered = sum(t[2] for t in tiles(np.array([names[w] for w in a], np.uint64), np.array([names[w] for w in b], np.uint64), 5))
                if covered / len(a) >= coverage:
                    out[d, i] = (len(a), covered)
    return out


def test_given_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    rows = queries.QUERIES["op9_decontamination"](spark, SF).collect()
    want = brute(dict(zip(docs.doc_id, docs.text)), dict(zip(bench.item_id, bench.text)), decontamination.COVERAGE)
    assert {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered) for r in rows} == want and len(rows) == len(want)
    whole = {d for d, t in zip(docs.doc_id, docs.text) for b in bench.text if b in (t or "")}
    assert whole <= {r.doc_id for r in rows}


def test_planted(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(6))
    bench = {i: " ".join(word() for _ in range(r.randint(20, 60))) for i in range(30)} | {90: "too short", 91: None, 92: ""}
    bench |= {50: bench[3] + " " + " ".join(word() for _ in range(9)), None: " ".join(["again"] * 30)}
    docs = {i: " ".join(word() for _ in range(300)) for i in range(40)}
    a = bench[0].split()
    docs |= {100: docs[0] + "\n" + bench[0].replace("a", "A").replace(" ", ",  ") + docs[1], 101: " ".join(a[len(a) // 2:] + [word()] + a[:len(a) // 2]),
             102: " ".join(a[:8]), 103: None, 104: "", 105: "again " * 500, 106: bench[3], 107: " x ".join(bench[k] for k in range(20)) * 5, None: bench[7]}
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()] + [(106, "a", 2, "y")], "doc_id long, text string, item_id int, id string")
    b = spark.createDataFrame([(i, t, 7) for i, t in bench.items()] + [(3, bench[3], 8)], "item_id long, text string, doc_id int")
    rows = decontamination.contaminations(d, b).collect()
    assert {(x.doc_id, x.item_id): (x.n_tokens, x.n_covered) for x in rows} == brute(docs, bench, decontamination.COVERAGE)
    hit = {x.doc_id for x in rows}
    assert {100, 101, 105, 106, 107, None} <= hit and 102 not in hit and not hit & set(range(40))
    left = decontamination.decontaminate(d, b)
    assert left.columns == d.columns and {x.doc_id for x in left.collect()} == set(docs) - hit
    assert decontamination.contaminations(d.limit(0), b).count() == 0 == decontamination.contaminations(d, b.limit(0)).count()
