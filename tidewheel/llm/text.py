"""Vectorised byte-level text helpers, run inside Spark tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about this many bytes, whatever the batch holds.
GROUP_BYTES = 4 << 20

_rng = np.random.default_rng(20240501)
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_place = [_rng.integers(0, 2**63, 1 << 12, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are anything but ASCII blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of lower-case ASCII letters, digits and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _places(n: int) -> np.ndarray:
    while len(_place[0]) < n:
        more = np.random.default_rng(len(_place[0])).integers(0, 2**63, len(_place[0]), dtype=np.int64)
        _place[0] = np.concatenate([_place[0], more.astype(np.uint64) * np.uint64(2) + np.uint64(1)])
    return _place[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts, each of about ``most`` bytes or one longer text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes], is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 64-bit hash, start, end) of each word of the joined texts.

    ``start`` and ``end`` are byte offsets in ``b"\\n".join(texts)``; a line feed must not be part of words.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    inside = is_word[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), start, end
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    parts = BYTE_CODE[buf[inside]] * _places(int(size.max()))[place]
    code = mix(np.add.reduceat(parts, at) + size.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, start, "right"), code, start, end


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit patterns as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
