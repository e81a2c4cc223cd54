"""Words of many texts at once, as arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time, but for longer texts.
BLOCK = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte, from a fixed seed: hashes must be the same in every task.
BYTE = np.random.default_rng(20240817).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * B
    h = (h ^ (h >> np.uint64(27))) * A
    return h ^ (h >> np.uint64(31))


class Words:
    """The words (runs of bytes other than space and \\t to \\r) of some texts, laid one behind the other.

    buf: the bytes; start, end: of each word; hash: of each word, A-Z as a-z; first: the number of each text's first
    word, and in the end that of all words; text_start, text_end: of each text."""

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(lens + 1) - lens - 1
        self.text_end = self.text_start + lens
        solid = ~SPACES[buf]
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.r_[np.searchsorted(self.start, self.text_start), len(self.start)]
        n = self.end - self.start
        self.hash = np.zeros(len(n), np.uint64)
        if len(n):
            at = np.cumsum(n) - n
            place = np.arange(at[-1] + n[-1]) - np.repeat(at, n)
            power = np.full(int(n.max()), A, np.uint64)
            power[0] = 1
            h = np.add.reduceat(BYTE[LOWER[buf[solid]]] * np.cumprod(power)[place], at)
            self.hash = mix(h + n.astype(np.uint64) * B)


def blocks(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) over a column of texts, null as empty."""
    rows, first, size = [], 0, 0
    for k, x in enumerate(col.cast(pa.binary())):
        t = x.as_buffer().to_pybytes() if x.is_valid else b""
        rows.append(t)
        size += len(t)
        if size >= BLOCK:
            yield first, k + 1, Words(rows)
            rows, first, size = [], k + 1, 0
    if rows:
        yield first, first + len(rows), Words(rows)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are unpacked at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Give memory that is free back to the system: idle Python workers otherwise keep what their last task needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ngrams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of words' hashes; of fewer words than ``size`` that of the whole sequence; of none none."""
    n = len(h)
    k = min(size, n)
    if not k:
        return np.zeros(0, np.uint64)
    out = h[: n - k + 1]
    for i in range(1, k):
        out = mix(out * A + h[i : n - k + 1 + i])
    return out if n >= size else out ^ np.uint64(k)
