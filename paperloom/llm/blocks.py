"""Hashing whole blocks of texts at once.

Documents are dealt into blocks of about BLOCK_BYTES of text.  A block sends the
hashes it holds to buckets by their leading bits, one packed row for each bucket,
and gets answers back the same way: both sides stay bounded, and a passage that
many documents share reaches a bucket once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

BLOCK_BYTES = 8 << 20
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def number_of_blocks(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-total // BLOCK_BYTES))


def block_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n))


def bounds(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit keys dealt evenly by their leading bits."""
    if not len(keys):
        return
    # 32 leading bits times the number of buckets, without overflow.
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), a, b


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the leading ones of sorted or small values compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(packed: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE_BYTES)
        held = _powers[0] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return held[0][:n], held[1][:n]


class Slice:
    """Some texts as one array of bytes with prefix hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        power, self.inverse = _power(len(self.data) + 1)
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from ``start`` to ``end``."""
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~_SPACE[self.data]
        begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = self.lengths > 0
        begin[self.starts[full]] = inside[1:-1][self.starts[full]]
        stop[self.ends[full] - 1] = inside[1:-1][self.ends[full] - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return start, end, np.searchsorted(self.ends, start, "right")


def slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) in pieces of about SLICE_BYTES; null is empty."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        held.append(raw)
        size += len(raw)
        if size >= SLICE_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held
