"""Words and their 64-bit hashes for whole Arrow batches, in numpy, without a Python object a word.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one step holds; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]


def _factors(a: int, b: int) -> np.ndarray:
    """The odd multipliers of the places a to b of a word, independent of each other."""
    return mix(np.arange(a + 1, b + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


FACTORS = _factors(0, 1 << 10)


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, a step's bytes at a time."""
    n = len(data)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tops, bottoms = offsets[:-1], offsets[1:] - 1
    for a in range(0, n, STEP_BYTES):
        b = min(n, a + STEP_BYTES)
        part = data[max(0, a - 1) : min(n, b + 1)]
        inside = np.zeros(b - a + 2, dtype=bool)
        inside[int(a == 0) : int(a == 0) + len(part)] = (part != 32) & ((part < 9) | (part > 13))
        own = inside[1:-1]
        begin, stop = own & ~inside[:-2], own & ~inside[2:]
        x = tops[np.searchsorted(tops, a) : np.searchsorted(tops, b)] - a
        begin[x] = own[x]
        x = bottoms[np.searchsorted(bottoms, a) : np.searchsorted(bottoms, b)] - a
        stop[x] = own[x]
        starts.append(np.flatnonzero(begin) + a)
        ends.append(np.flatnonzero(stop) + (a + 1))
    return np.concatenate(starts), np.concatenate(ends)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per word the sum over its bytes of the byte's value times its place's factor, a step's bytes at a time."""
    out = np.zeros(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + STEP_BYTES, side="right")))
        b = int(ends[j - 1])
        if b - a > STEP_BYTES:  # one long word
            for x in range(a, b, STEP_BYTES):
                y = min(b, x + STEP_BYTES)
                out[i : i + 1] += (table[data[x:y]] * _factors(x - a, y - a)).sum(dtype=U)
        else:
            own = starts[i:j]
            place = np.arange(a, b) - np.repeat(own, np.diff(own, append=b))
            long = int((ends[i:j] - own).max())
            factors = FACTORS if long <= len(FACTORS) else _factors(0, long)
            total = np.zeros(b - a + 1, dtype=U)
            np.cumsum(table[data[a:b]] * factors.take(place, mode="clip"), out=total[1:])
            out[i:j] = total[ends[i:j] - a] - total[own - a]
        i = j
    return out


class Words:
    """The words of some consecutive texts: byte ranges, hashes, and first[i]:first[i + 1] for text i.

    A hash is multilinear: each place of a word has a factor of its own, so no pattern of bytes cancels out as in a polynomial.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.data, self.offsets = data, offsets
        self.starts, self.ends = _edges(data, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = mix(_sums(data, self.starts, self.ends, BYTE_LOWER if lower else BYTE) + U(0x51))

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def steps(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) for runs of rows of about STEP_BYTES each."""
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1
        to = min(n, max(to, at + 1))
        part = offsets[at : to + 1]
        yield at, to, Words(data[part[0] : part[-1]], part - part[0], lower)
        at = to


#: Fixed multipliers of a shingle's word places.
PLACE = mix(np.arange(11, 43, dtype=U))


def shingles(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Per text: hashes of its runs of `size` words in order; with fewer words, of the whole sequence; empty without words."""
    h = words.hashes
    whole = np.zeros(0, dtype=U)
    if len(h) >= size:
        m = len(h) - size + 1
        whole = h[:m] * PLACE[0]
        for k in range(1, size):
            whole = whole + h[k : k + m] * PLACE[k]
        whole = mix(whole)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield whole[a : b - size + 1]
        elif b > a:
            yield mix((h[a:b] * PLACE[: b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield whole[:0]
