"""Numpy helpers over many texts at once: words, word hashes, hashes of word n-grams and of byte windows.

Texts come as Arrow batches and are taken in chunks of bounded size, a text longer than that alone. A polynomial hash modulo
2 ** 64 is kept as prefix sums, from which the hash of any stretch follows; a final mix spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
NO_TOKEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest asked for so far is kept, up to a chunk."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(int(out[-1]) * int(base) % (1 << 64))])
        held = out[:size]
        if size <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = held
    return held[:n]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of a batch, a few MB at a time; NULL is empty."""
    held, size, first = [], 0, 0
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else pa.binary()
    values = values.cast(kind)
    for i in range(len(values)):
        text = values[i].as_py() or b""
        if held and size + len(text) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal stretches of equal length have equal ones."""
    shift = powers(INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], lower: bool = False, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, text of every word, words of every text); words are runs of bytes that are no `gap`."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    if lower:
        data = LOWER[data]
    inside = np.concatenate([[False], ~gap[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(offsets, starts, "right") - 1
    return stretch_hashes(prefix_sums(data), starts, ends), owner, np.bincount(owner, minlength=len(texts))


def grams(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every n-gram of words; a text with fewer words, if it has any, gives its whole sequence as one."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(hashes)) - first[owner]
    left = counts[owner] - place
    full = left >= n
    short = (counts[owner] < n) & (place == 0)
    at = np.flatnonzero(full | short)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = left[at] > k
        word = np.where(there, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word + there.astype(np.uint64))
    return out, owner[at], place[at]
