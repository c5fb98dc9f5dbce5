"""Vectorised word hashing over the byte buffers of Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Hashes are 64-bit: two different words (or
shingles) share one with probability of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
CHUNK = 2 << 20
#: Rows of a batch taken at a time, so that a task holds copies of few texts.
ROWS = 512
WRAP = 1 << 64
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, WRAP)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[LOWER]
POWERS, INVERSES = _powers(BASE), _powers(BASE_INVERSE)
WEIGHTS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows ``data[offsets[i]:offsets[i + 1]]``, and per row the index of its first word
    (one entry more than rows). Memory is a few bytes for each byte of text plus the result, however long a row is."""
    n = len(data)
    gap = SPACE[data]
    first = np.ones(n, dtype=bool)
    first[1:] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last = np.ones(n, dtype=bool)
    last[:-1] = gap[1:]
    last[inner - 1] = True
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap)
    before, after, scale = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    total = np.uint64(0)
    for at in range(0, n, PIECE):
        piece = BYTES[data[at:at + PIECE]]
        terms = piece * POWERS[:len(piece)] * np.uint64(pow(BASE, at, WRAP))
        sums = np.cumsum(terms, dtype=np.uint64) + total
        a, b = np.searchsorted(starts, [at, at + PIECE])
        here = starts[a:b] - at
        before[a:b] = sums[here] - terms[here]
        scale[a:b] = INVERSES[here] * np.uint64(pow(BASE_INVERSE, at, WRAP))
        a, b = np.searchsorted(ends, [at, at + PIECE])
        after[a:b] = sums[ends[a:b] - at]
        total = sums[-1]
    return mixed((after - before) * scale), np.searchsorted(starts, offsets)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of successive row ranges of about CHUNK bytes; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes (int64) of its runs of ``size`` words; all words as one run when fewer."""
    for _, rows, data, offsets in chunks(column):
        words, firsts = word_hashes(data, offsets)
        runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for j in range(size):
            runs += words[j:j + len(runs)] * WEIGHTS[j]
        runs = mixed(runs).view(np.int64)
        for i in range(rows):
            a, b = firsts[i], firsts[i + 1]
            if b - a >= size:
                yield np.unique(runs[a:b - size + 1])
            elif b > a:
                parts = np.append(words[a:b] * WEIGHTS[:b - a], WEIGHTS[32 + b - a])
                yield mixed(np.add.reduce(parts, keepdims=True)).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)
