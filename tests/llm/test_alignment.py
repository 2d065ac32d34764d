"""Tokens, groups, links and corpus counts against the definitions, token by token; odd texts and tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auditlens.llm import alignment
from auditlens.llm.common import table
from tests.conftest import SF

FOLDER = alignment.VOCABULARIES


@pytest.fixture(scope="module")
def reference():
    a = Tokenizer.from_file(f"{FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.PIECE_BPE}")


def byte_level():
    keep = [b for b in range(256) if chr(b).isprintable() and b != 32 and not 127 <= b <= 160 and b != 173]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(texts, reference):
    """What the contract says, from all overlaps."""
    a, b = reference
    table = byte_level()
    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False) if text else None
        ids = b.encode(text) if text else []
        ta = [bytes(table[c] for c in t) for t in x.tokens] if text else []
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            found.append(None)
            continue
        sa, sb = spans(ta), spans(tb)
        links, k = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[k][1] <= s:
                k += 1
            j = k
            while j < len(sb) and sb[j][0] < e:
                links.append((x.ids[i], ids[j]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x.ids[i]) for i, (s, e) in enumerate(sa) if low < e <= c) + "|" + ",".join(str(ids[j]) for j, (s, e) in enumerate(sb) if low < e <= c))
            low = c
        found.append((len(sa), len(sb), len(groups), links, ";".join(groups)))
    count = Counter(p for f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*f[:3], len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


def measures(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


@pytest.mark.parametrize("block", [alignment.BLOCK, 5_000])
def test_given_documents(spark, reference, block):
    docs = table(spark, SF, "documents").where("length(text) < 6000")
    rows = docs.collect()
    got = dict(measures(alignment.token_alignment(docs.repartition(5), block=block)))
    assert got == dict(zip((r.doc_id for r in rows), plain([r.text for r in rows], reference)))


ODD = ["", None, " ", "  two  gaps ", "a", "▁mark ▁", "<0x41> <s> </s> <unk> <|endoftext|>", "é ü ß 中文字 ‮ ﬁ 👩‍👩‍👧 \U000e0001", "tab\tline\r\n\n\x00\x7f",
       "x" * 3000, " " * 2000 + "y", "don't we'll 123456 ...!!!", " nbsp　wide", "é Å", "�"]


def test_odd_texts(spark, reference):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n'\t1é中🙂▁<>|.") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, i, "p") for i, t in enumerate(texts)], "doc_id long, text string, block long, pair string")
    got = dict(measures(alignment.token_alignment(df.repartition(3), block=700)))
    assert [got[i] for i in range(len(texts))] == plain(texts, reference)


def test_odd_tables(spark, reference):
    schema = "doc_id long, text string, block string, docs int, pairs string"
    df = spark.createDataFrame([(None, "one two", "b", 1, None), (3, "one two", None, None, "x"), (3, "one two", None, None, "x"), (4, None, None, None, None)], schema)
    want = plain(["one two", "one two", "one two", None], reference)
    assert sorted(measures(alignment.token_alignment(df)), key=repr) == sorted(zip([None, 3, 3, 4], want), key=repr)
    assert alignment.token_alignment(df.limit(0)).count() == 0
    only = alignment.token_alignment(df.where("doc_id = 4"))
    assert measures(only) == [(4, (0, 0, 0, 0, 0, 0, ""))]


def test_steps():
    """Texts of different lengths, some without tokens, merged at the same time."""
    a_end, b_end = np.array([2, 5, 6, 9]), np.array([5, 6, 7, 8, 9])
    link_a, link_b, cut_a, cut_b = alignment.lockstep(a_end, b_end, np.array([0, 2, 2]), np.array([2, 2, 4]), np.array([0, 1, 1]))
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (1, 0), (2, 1), (3, 2), (3, 3), (3, 4)]
    assert sorted(zip(cut_a.tolist(), cut_b.tolist())) == [(1, 0), (2, 1), (3, 4)]
