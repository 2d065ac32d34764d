"""Removed passages against a table of all windows; buckets and boundaries; odd texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from auditlens.llm import queries, suffix_dedup
from auditlens.llm.suffix_sort import Bucket, multikey_order
from tests.conftest import SF


def brute(texts, width=100):
    seen, out = set(), {}
    for i in sorted(texts, key=lambda i: (i is None, i)):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            w = data[p:p + width]
            if w in seen:
                gone[p:p + width] = b"\1" * width
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(rows, texts):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts) and len(rows) == len(texts)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    check(queries.QUERIES["op5_suffix_dedup"](spark, SF).collect(), dict(zip(docs.doc_id, docs.text)))


@pytest.fixture(scope="module")
def noisy():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé\x00 ") for _ in range(r.randint(1, 9))) for _ in range(80)]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice((30, 90, 200)))) for _ in range(8)]
    texts = {}
    for i in range(150):
        t = list(" ".join(r.choice(base)[r.randint(0, 60):][:r.randint(50, 700)] for _ in range(r.randint(1, 3))))
        for _ in range(r.choice((0, 0, 1, 4))):
            t[r.randrange(len(t))] = r.choice("xyz😀")
        texts[i * 2] = "".join(t)
    return texts | {1: None, 3: "", 5: "a" * 99, 7: "a" * 100, 9: "a" * 1000, 11: "ab" * 400, 13: "\x00" * 300, None: "a" * 150}


@pytest.mark.parametrize("small", [False, True])
def test_against_all_windows(spark, noisy, small, monkeypatch):
    if small:  # buckets of a few suffixes, lists of two
        monkeypatch.setattr(suffix_dedup, "SORTED", 60)
        monkeypatch.setattr(suffix_dedup, "LISTED", 2)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in noisy.items()] + [(7, "a" * 100, 2, "y")], "doc_id long, text string, first int, id string")
    check(suffix_dedup.dedup_passages(df.repartition(7)).collect(), noisy)


def test_all_repeats_are_sorted_and_some_meet_across_boundaries(spark):
    """Exact copies come by the sort too: what buckets and their boundaries find is all there is."""
    r = random.Random(6)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (130, 400, 900)]
    texts = {i: f"{i} " * 9 + passages[2] if i % 3 else passages[i % 2] + f" {i}" * 20 for i in range(400)}
    df = spark.createDataFrame([*texts.items()], "id long, text string")
    within, across = suffix_dedup.interval_parts(df)
    starts = lambda part: {(x.id, (x.span >> 8) + k) for x in part.collect() for k in range((x.span & 255) + 1)}
    inside, beyond = starts(within), starts(across)
    seen, again = set(), set()
    for i in sorted(texts):
        data = texts[i].encode()
        for p in range(len(data) - 99):
            again |= {(i, p)} if data[p:p + 100] in seen else set()
            seen.add(data[p:p + 100])
    assert inside and beyond and inside | beyond == again


def test_empty_and_kept_bytes(spark):
    r = random.Random(8)
    shared = "é".join(r.choice("abcdefgh") for _ in range(60))
    df = spark.createDataFrame([(1, "head" + shared), (2, shared + "tail")], "doc_id long, text string")
    assert suffix_dedup.dedup_passages(df.limit(0)).count() == 0
    out = {r.doc_id: r for r in suffix_dedup.dedup_passages(df, texts=True).collect()}
    assert bytes(out[2].kept) == b"tail" and out[2].runs == [0, len(shared.encode())] and out[1].n_removed == 0


def test_multikey_order():
    r = random.Random(1)
    rows = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 24))) for _ in range(3000)]
    data = np.frombuffer(b"".join(x.ljust(24, b"\0") for x in rows), ">u8").reshape(-1, 3).astype(np.uint64)
    assert [rows[k] for k in multikey_order(data, np.array([len(x) for x in rows]))] == sorted(rows)


def test_bucket_finds_equal_windows_only():
    b = Bucket([b"cdefXX", b"cdefgh", b"cdef"], [b"ba", b"ba", b"bz"], np.array([3, 1, 2]), np.array([2, 2, 2]), 6)
    found = {(int(i), s) for i, a, z in zip(*b.intervals()) for s in range(a, z + 1)}
    assert found == {(3, 0)}


def test_pieces_and_flushes(monkeypatch):
    """Every window is in one segment, however a text is cut and however often a task flushes."""
    r = random.Random(4)
    texts = ["".join(r.choice("abc ") for _ in range(n)) for n in (5, 99, 100, 101, 500, 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    for piece, flush in ((1 << 20, 1 << 20), (128, 20)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
        monkeypatch.setattr(suffix_dedup.chunks, "__defaults__", (piece,))
        found = []
        for out in suffix_dedup._segments(iter([batch])):
            for row in out.to_pylist():
                found += [(i, (at >> 16) + k) for i, at in zip(row["at"][::2], row["at"][1::2]) for k in range((at & 255) + 1)]
        assert sorted(found) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]
