"""Words of a batch of texts as arrays: bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

# Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
WORDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
# Everything but white space.
VISIBLE = np.array([not chr(b).isspace() or b >= 0x80 for b in range(256)])


# Characters whose words are in memory at once, but for a single longer text.
SLICE = 1 << 18


def slices(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``most`` characters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Flat arrays over all words of all texts; text i has words first[i]:first[i + 1]."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = self.hash[: n - k + 1].copy()
        for i in range(1, k):
            out = out * _BASE + self.hash[i : n - k + 1 + i]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mixed(out), text[: n - k + 1] == text[k - 1 :]


def scan(texts: list[str], inside: np.ndarray = WORDS) -> Words:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    word = inside[buffer]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    length = end - start
    first = np.cumsum(length) - length
    if len(start):
        powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        place = np.arange(int(length.sum()), dtype=np.int32 if len(buffer) < 2**31 else np.int64)
        place -= np.repeat(first.astype(place.dtype), length)
        terms = powers[place]
        terms *= buffer[word] + np.uint64(1)
        hashes = mixed(np.add.reduceat(terms, first))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(buffer, start, end, hashes, np.searchsorted(start, bounds))
