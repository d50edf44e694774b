"""Whole batches of text as numpy arrays: the shared inner step of the operators that read every byte.

Everything here works on one slice of an Arrow batch inside a task; the slices are bounded in bytes, so
the memory of a Python worker does not depend on the number or the length of the rows in a batch, except
that one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: digits, letters and every byte of a character beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True

_weights = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def weights(n: int) -> np.ndarray:
    """At least ``n`` fixed pseudo-random odd multipliers, one per place in a word."""
    global _weights
    if len(_weights) < n:
        _weights = mix(np.arange(1, max(n, 1024) * 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights


def run_hashes(symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of symbols; the runs lie one after the other and are not empty."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(symbols), dtype=np.int64)
    place -= np.repeat(first, length)
    terms = weights(int(length.max()) + 1)[place]
    terms *= symbols.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        ends = offsets_of(batch.column(column))[1][1:]
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else ends[0] - ends[0]
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the len + 1 offsets of its rows; null is an empty text."""
    raw = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The lower-cased words of a slice of texts.

    A word is a run of digits, ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Words
    are known by a 64-bit hash: two different words of a corpus of 10^9 distinct ones agree with a
    probability of about 0.03.
    """

    def __init__(self, column: pa.Array):
        data, self.offsets = offsets_of(column)
        data = LOWER[data]
        mask = IN_WORD[data]
        edge = np.empty(len(mask) + 1, dtype=bool)
        if len(mask):
            edge[0], edge[-1] = mask[0], mask[-1]
            np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(mask))]
            glued = inner[mask[inner] & mask[inner - 1]]  # a word at the end of one text and at the start of the next
        else:
            edge[:] = False
            glued = np.zeros(0, dtype=np.int64)
        flips = np.flatnonzero(edge)
        if len(glued):
            flips = np.sort(np.concatenate([flips, glued, glued]))
        start, end = flips[::2], flips[1::2]
        keep = end > start
        self.start, self.end = start[keep], end[keep]
        length = self.end - self.start
        first = np.cumsum(length) - length
        self.hash = run_hashes(data[mask], first, length)
        #: Index of the first word of each text, and one more entry for the end.
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(column)), self.counts)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
