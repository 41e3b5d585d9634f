"""Words of many texts at once: boundaries and 64-bit hashes from flat UTF-8 bytes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # bytes hashed at once; cut between words, so block borders never show

_BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins (one more than texts); nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    stored = texts.buffers()[2]
    data = np.frombuffer(stored, np.uint8) if stored is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, one text at least."""
    lengths = np.cumsum(np.diff(flat_texts(texts)[1]))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Folding:
    """Which bytes separate words, and the value each other byte counts as."""

    def __init__(self, separators: bytes | np.ndarray, lower: bool = True) -> None:
        self.is_word = np.ones(256, bool)
        self.is_word[np.frombuffer(separators, np.uint8) if isinstance(separators, bytes) else separators] = False
        self.values = _BYTE_VALUES.copy()
        if lower:
            self.values[65:91] = self.values[97:123]
        self._powers = self._inverse = np.ones(1, np.uint64)

    def _grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n + 1:
            steps = np.full(n + 1, _BASE)
            back = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 2**64)))
            steps[0] = back[0] = 1
            self._powers, self._inverse = np.cumprod(steps), np.cumprod(back)
        return self._powers, self._inverse

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word; words never cross the ``offsets`` of texts."""
        word = self.is_word[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = word[first]
        last = first[1:] - 1
        ends[last] = word[last]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def hashes(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each span. Spans are in order and do not overlap."""
        out = np.empty(len(begins), np.uint64)
        at = 0
        while at < len(begins):
            base = begins[at]
            to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
            block = data[base : ends[to - 1]]
            powers, inverse = self._grown(len(block))
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(self.values[block] * powers[: len(block)], out=sums[1:])
            a, b = begins[at:to] - base, ends[at:to] - base
            out[at:to] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            at = to
        return out


def owners(offsets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many words begin before each offset: word ``i`` of text ``t`` is between entries ``t`` and ``t + 1``."""
    return np.searchsorted(begins, offsets)
