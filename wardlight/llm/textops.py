"""Words and their hashes, straight from the buffers of an Arrow string column.

Nothing here makes a Python string a word: bytes are classed by a table, words are runs of a class, and a word's hash is
a polynomial of its bytes modulo 2**64, summed in one pass. Long texts go in pieces that end between words, so beyond
some numbers for each word, memory doesn't grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One odd random number for each byte, and powers of an odd number.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.where(np.arange(1 << 16) == 0, np.uint64(1), np.uint64(_MULTIPLIER)))

#: Words between white space, and words of digits, letters and all bytes outside ASCII.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets start at 0; a null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of consecutive texts: byte ranges, hashes, and the index of each text's first word."""

    def __init__(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.start, self.end, self.hash, self.first = start, end, hashes, first


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]: maximal runs of bytes in ``kind`` (after A-Z are lower-cased, if ``fold``)."""
    member = kind[LOWER] if fold else kind
    values = BYTE[LOWER] if fold else BYTE
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + PIECE)
        while stop < n:  # a piece ends between words
            tail = ~member[data[stop : stop + PIECE]]
            cut = np.searchsorted(offsets, stop)
            gap = int(np.argmax(tail)) if tail.any() else len(tail)
            edge = int(offsets[cut]) - stop
            stop += min(gap, edge)
            if gap < len(tail) or edge <= gap:
                break
        piece = data[at:stop]
        inside = member[piece]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edges[edges < len(piece)]] = inside[edges[edges < len(piece)]]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        lasts = edges[edges > 0] - 1
        finish[lasts] = inside[lasts]
        s, e = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        if len(s):
            where = np.flatnonzero(inside)
            power = where - np.repeat(s, e - s)
            if int((e - s).max()) > len(POWERS):
                power &= len(POWERS) - 1
            sums = np.add.reduceat(values[piece[where]] * POWERS[power], np.concatenate([[0], np.cumsum(e - s)[:-1]]))
            hashes.append(mix(sums + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, dtype=t)
    start = join(starts, np.int64)
    return Words(start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one or several texts; runs that cross into the next text are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out ^= out >> np.uint64(32)
    return mix(out)


def groups(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together; a longer text comes alone."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(stop, len(column))
        at = stop


def counts(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of each text are true."""
    size = np.diff(offsets)
    out = np.zeros(len(size), dtype=np.int64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(member, offsets[some], dtype=np.int64)
    return out
