"""Words and word windows of whole Arrow string columns, as numpy arrays.

Everything here works on the UTF-8 bytes of a batch at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the memory of the temporary arrays.
CHUNK_BYTES = 2_000_000

_SPACES = np.array([0x20, *range(0x09, 0x0E)])
SPACED = np.ones(256, bool)
SPACED[_SPACES] = False
PLAIN = np.zeros(256, bool)
PLAIN[0x80:] = True
PLAIN[ord("0") : ord("9") + 1] = True
PLAIN[ord("a") : ord("z") + 1] = True
PLAIN[ord("A") : ord("Z") + 1] = True  # where words are read with lower=True

_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed * 0x5851F42D4C957F2D % 2**64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(seed: int, n: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        size = max(64, 1 << (int(n) - 1).bit_length())
        _POWERS[seed] = have = stream(seed + 1000, size) | np.uint64(1)
    return have


@dataclass
class Words:
    """Words of some consecutive texts of a batch."""

    data: np.ndarray  #: bytes of these texts
    starts: np.ndarray  #: of each word, in ``data``
    ends: np.ndarray
    bounds: np.ndarray  #: text i has the words bounds[i] up to bounds[i + 1]
    first: int  #: row of the first text in its batch

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, lower: bool = False, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        letters = stream(seed, 256)
        if lower:
            letters = letters[_LOWER]
        value = letters[self.data[np.repeat(self.starts, lens) + place]] * _powers(seed, int(lens.max()))[place]
        return mix(np.add.reduceat(value, at) + lens.astype(np.uint64) * _GOLDEN)

    def joined(self, at: np.ndarray) -> bytes:
        """The words ``at``, in rising order, joined by one blank."""
        if not len(at):
            return b""
        lens = self.ends[at] - self.starts[at] + 1  # each with what follows it, which turns into the blank
        upto = np.cumsum(lens)
        out = self.data[(np.repeat(self.starts[at] - (upto - lens), lens) + np.arange(int(upto[-1])))[:-1]]
        out[upto[:-1] - 1] = 0x20
        return out.tobytes()

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words; the caller leaves out the runs that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weight = stream(seed + 2000, k) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * weight[j]
    return mix(total + np.uint64(k))


def whole(bounds: np.ndarray, k: int) -> np.ndarray:
    """The starts of the ``k``-word windows that lie in one text."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(at, counts) + np.repeat(bounds[:-1], counts)


def _as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, places


def _words(data: np.ndarray, places: np.ndarray, letters: np.ndarray, first: int) -> Words:
    inside = letters[data]
    cuts = places[1:-1]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, places), first)


def words(column: pa.Array | pa.ChunkedArray, letters: np.ndarray) -> Iterator[Words]:
    """The words of every text of ``column``, about CHUNK_BYTES of text at a time; a longer text comes alone and whole."""
    data, places = _as_bytes(column)
    begin = 0
    while begin < len(places) - 1:
        end = max(begin + 1, int(np.searchsorted(places, places[begin] + CHUNK_BYTES, "right")) - 1)
        yield _words(data[places[begin] : places[end]], places[begin : end + 1] - places[begin], letters, begin)
        begin = end
