"""Words, shingles and windows of whole Arrow batches as 64-bit numbers, in NumPy, and packed exchanges of such numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit unstirred."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed odd numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = stream(11, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some texts one after another: where they start and end in data, their hashes, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(U), np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    shuts[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, start, end, np.zeros(0, U), first)
    size = end - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
    if place is None:
        place = np.arange(len(data)) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data))))))
    weight = stream(29, int(size.max()))
    value = _BYTE[_LOWER[data] if lower else data] * weight[np.minimum(place, len(weight) - 1)]
    value[~inside] = 0
    total = np.add.reduceat(value, start)
    return Words(data, start, end, mix(total + size.astype(U) * U(0xD6E8FEB86659FD93)), first)


def scan(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of texts a to b) over the whole array, a few megabytes at a time; null texts have no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield a, b, _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        a = b


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of the word hashes h, over text borders too."""
    if len(h) < n:
        return h[:0]
    weight, m = stream(47, n), len(h) - n + 1
    total = np.zeros(m, U)
    for i in range(n):
        total += h[i : i + m] * weight[i]
    return mix(total)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as ascending hashes; with fewer words (but one), the whole sequence is the shingle."""
    every, out = windows(w.hash, n), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        else:
            out.append(windows(w.hash[a:b], int(b - a)) if b > a else w.hash[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, as Spark's bigint."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s + U(5))), s.sum(dtype=U), len(s)], U) * stream(3, 3)).sum(dtype=U).astype(np.int64))


PACKED = "part int, block binary"


def packed(part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """rows (a structured array) as one binary a part, so that the shuffle moves few large rows."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(part))[: len(at)]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["part", "block"])


def unpacked(blocks: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blocks.to_pylist()), kind)


def parts_for(entries: float, each: int, spark) -> int:
    """How many parts give each about `each` entries: with the data, not below the session's shuffle partitions."""
    return int(min(1 << 30, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // each))))
