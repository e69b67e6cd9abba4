"""Words of whole texts as 64-bit hashes, by numpy over the UTF-8 bytes of many texts at once.

A word is a run of bytes other than space and the controls 0x09 to 0x0D; A-Z count as a-z. Equal
words have equal hashes; different ones share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21

# The constants of the splitmix64 generator's finishing step.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_draw = np.random.default_rng(20_240_229)
_LETTER = _draw.integers(0, 1 << 64, 256, np.uint64)[LOWER]
_PLACE = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = int(_draw.integers(0, 1 << 64, dtype=np.uint64)) | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n, and their inverses, modulo 2**64."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK) + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


def byte_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, their bytes and offsets, in chunks of about size bytes; a longer text is a chunk by itself. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Runs:
    """Runs of bytes between separators, in the order of the texts: start, end, hash, and each text's first run (with the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_LETTER[data], powers(len(data))[0][: len(data)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, prefix: np.ndarray | None = None) -> Runs:
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix = prefix_hashes(data) if prefix is None else prefix
    return Runs(starts, ends, hash_spans(prefix, starts, ends), np.searchsorted(starts, offsets))


def shingles(words: Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of k words, in order; a text of fewer words has its whole sequence as one, one without words none."""
    counts, doc, h = words.counts, words.doc, words.hashes
    n = max(0, len(h) - k + 1)
    whole = np.full(n, np.uint64(k))
    for j in range(k):
        whole += h[j : j + n] * _PLACE[j]
    fits = doc[:n] == doc[k - 1 :] if n else np.zeros(0, bool)
    hashes, docs = [whole[fits]], [doc[:n][fits]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            own = np.full(len(short), np.uint64(m))
            for j in range(m):
                own += h[words.first[short] + j] * _PLACE[j]
            hashes.append(own)
            docs.append(short)
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    return mix(hashes), docs


def distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, doc) pairs by doc, then hash, with how often each occurs."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))
