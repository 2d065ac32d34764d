"""Alignment of two tokenizers over whole texts: which tokens overlap, where both end together, how often pairs occur in the corpus.

A byte-level BPE (A) reads a space and the text, a piece BPE with byte fallback (B) the text, to which it adds the space itself. Both
give the same bytes, so a token is a stretch of them. All texts of a block are merged at the same time: one vector of pointers into
A's tokens and one into B's, a step advances in every text the token that ends first, or both where they end together, and texts that
are through leave the vectors.

Counts over the corpus need a second look at every text. So a block keeps its distinct pairs once, and each text as places in that
list; it asks for the counts of its pairs, and no text's links are ever shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm.common import cut

VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a block; a longer text is a block alone.
BLOCK = 4 << 20
#: How a byte-level BPE of this kind cuts texts before merging, fixed.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIR = 1 << 32
BLOCK_ROW = ("block long, docs array<struct<doc_id:long, n_a:long, n_b:long, n_groups:long, n_links:long, groups_sha256:string, n_pairs:long>>, "
             "pairs binary, n_docs binary, place binary, times binary")


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(byte_bpe)
        # A byte-level vocabulary writes printable bytes as themselves and the others, in order, as characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        if any(model["model"]["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("ids of the byte-level vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        # An id as it is written in the list of groups: first of a group in A, later in A, first in B, later in B.
        self.written = [sep + b"%d" % i for sep, count in ((b";", len(self.a_bytes)), (b",", len(self.a_bytes)),
                                                           (b"|", len(self.b_bytes)), (b",", len(self.b_bytes))) for i in range(count)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A and by B of every text; None for an empty one and for one that a tokenizer does not give back byte by byte."""
        pieces = self.b.encode(texts, num_threads=1)
        out = []
        for text, b in zip(texts, pieces):
            whole = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


@cache
def tokenizers(byte_bpe: bytes, piece_bpe: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A token, B token) of all links and of all cuts of texts whose tokens lie one after another; ends are byte offsets.

    A text's tokens of A are a_from to a_to - 1, those of B begin at b_from; both have the same last end.
    """
    a, b, stop = a_from[a_to > a_from], b_from[a_to > a_from], a_to[a_to > a_from]
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(a):
        link_a.append(a)
        link_b.append(b)
        ends_a, ends_b = a_end[a], b_end[b]
        both = ends_a == ends_b
        cut_a.append(a[both])
        cut_b.append(b[both])
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (link_a, link_b, cut_a, cut_b))


def align(texts: list[str], tools: Tokenizers) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures of every text, distinct pairs, texts that hold each, and for every text the places of its pairs and how often)."""
    ids = tools.encode(texts)
    none = np.zeros(0, np.int64)
    a_ids = [x[0] if x else none for x in ids]
    b_ids = [x[1] if x else none for x in ids]
    n_a, n_b = (np.array([len(x) for x in part], np.int64) for part in (a_ids, b_ids))
    a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
    a, b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
    link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b]), a_to - n_a, a_to, b_to - n_b)
    count = len(texts)
    of_a = np.repeat(np.arange(count), n_a)
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of_a[cut_a], minlength=count), "n_links": np.bincount(of_a[link_a], minlength=count)}
    out["groups_sha256"] = _digests(a, b, np.sort(cut_a), np.sort(cut_b), a_to, b_to, n_a, tools)
    pairs, at = np.unique(a[link_a] * PAIR + b[link_b], return_inverse=True)
    held, times = np.unique(of_a[link_a] * max(1, len(pairs)) + at, return_counts=True)
    text, place = np.divmod(held, max(1, len(pairs)))
    out["n_pairs"] = np.bincount(text, minlength=count)
    return out, pairs, np.bincount(place, minlength=len(pairs)), place, times


def _digests(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, n_a: np.ndarray,
             tools: Tokenizers) -> list[str]:
    """Digests of the written groups: tokens of A and B of a group after one another, each with the mark that goes before it."""
    a_first, b_first = np.concatenate([[0], cut_a + 1])[:-1], np.concatenate([[0], cut_b + 1])[:-1]
    of_a, of_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
    kinds_a, kinds_b = len(tools.a_bytes), len(tools.b_bytes)
    code_a, code_b = a + kinds_a, b + 2 * kinds_a + kinds_b
    code_a[a_first] -= kinds_a
    code_b[b_first] -= kinds_b
    codes = np.zeros(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + b_first[of_a]] = code_a
    codes[np.arange(len(b)) + cut_a[of_b] + 1] = code_b
    ends = a_to + b_to
    out = []
    for k, n in enumerate(n_a.tolist()):
        begin = int(ends[k - 1]) if k else 0
        line = b"".join(map(tools.written.__getitem__, codes[begin:int(ends[k])].tolist()))[1:]
        out.append(hashlib.sha256(line).hexdigest() if n else "")
    return out


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts of a block at a time, texts of like length together, so that they are through after like steps."""
    texts = batch.column("text").cast(pa.large_string())
    sizes = np.array([len(t) if t else 0 for t in texts.cast(pa.large_binary()).to_pylist()])
    rows, held, total = [], [], 0
    for k in np.argsort(sizes, kind="stable").tolist():
        if held and total + sizes[k] > limit:
            yield rows, held
            rows, held, total = [], [], 0
        rows.append(k)
        held.append(texts[k].as_py() or "")
        total += int(sizes[k])
    if held:
        yield rows, held


def _read(spark: SparkSession, folder: str):
    """The two vocabulary files, under 3 MB, as a broadcast: executors need no copy of the folder."""
    files = []
    for name in (BYTE_BPE, PIECE_BPE):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    return spark.sparkContext.broadcast(tuple(files))


def token_alignment(docs: DataFrame, folder: str = VOCABULARIES, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for every row of the table.

    Tokens, groups that end at the same byte in both tokenizations, links between overlapping tokens; links whose pair of ids is the
    most frequent of its A id over the corpus, counted by documents; sum of those counts over all links; digest of the groups as
    `a1,a2|b1;a3|b2,b3`. A text that is NULL, empty, or not given back byte by byte by both tokenizers has zeros and the digest ''.
    Rows that repeat an id are documents of their own. Further columns are not looked at. An empty table gives no rows.
    """
    files = _read(docs.sparkSession, folder)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in _blocks(batch, block):
                measures, pairs, n_docs, place, times = align(texts, tokenizers(*files.value))
                columns = [batch.column("doc_id").take(pa.array(rows)), *(pa.array(v) for v in measures.values())]
                held = pa.StructArray.from_arrays(columns, ["doc_id", *measures])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), held),
                     *(pa.array([_pack(v)], pa.binary()) for v in (pairs, n_docs.astype(np.int32), place.astype(np.int32), times.astype(np.int32)))],
                    ["block", "docs", "pairs", "n_docs", "place", "times"])
                number += 1

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n_docs = _unpack(row["pairs"], np.int64), _unpack(row["n_docs"], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"])), pa.array(pairs), pa.array(n_docs.astype(np.int64))],
                                                 ["block", "pair", "n_docs"])

    def finish(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(answers.column("pair").to_numpy())
        count, best = (answers.column(c).to_numpy()[order] for c in ("count", "best"))
        for row in blocks.to_pylist():
            place, times = _unpack(row["place"], np.int32), _unpack(row["times"], np.int32).astype(np.int64)
            text = np.repeat(np.arange(len(row["docs"])), [d["n_pairs"] for d in row["docs"]])
            n_best, total = np.zeros(len(row["docs"]), np.int64), np.zeros(len(row["docs"]), np.int64)
            np.add.at(n_best, text, times * best[place])
            np.add.at(total, text, times * count[place])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            out.append(pa.table({**{c: pa.array([d[c] for d in row["docs"]], pa.int64()) for c in names}, "n_best": n_best, "count_sum": total,
                                 "groups_sha256": pa.array([d["groups_sha256"] for d in row["docs"]], pa.string())}))
        return pa.concat_tables(out)

    held = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(load, BLOCK_ROW))
    asks = held.select("block", "pairs", "n_docs").mapInArrow(asked, "block long, pair long, n_docs long")
    by_a = Window.partitionBy(F.shiftright("pair", 32))  # bounded by B's vocabulary
    counts = (asks.groupBy("pair").agg(F.sum("n_docs").alias("count"))
              .withColumn("best", (F.col("count") == F.max("count").over(by_a)).cast("long")))
    answers = asks.select("block", "pair").join(counts, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = held.select("block", "docs", "place", "times")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
