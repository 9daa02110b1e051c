"""Hashes of words and word runs over whole batches, with numpy."""

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 16  # words hashed at once
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if _powers.size < n:
        _powers = np.cumprod(np.full(1 << n.bit_length(), BASE, np.uint64), dtype=np.uint64)
    return _powers


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit hash a word; memory follows SLICE words, not the text."""
    out = np.zeros(len(words), np.uint64)
    for at in range(0, len(words), SLICE):
        some = words[at:at + SLICE]
        lengths = np.fromiter(map(len, some), np.int64, len(some)) + 1
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b" ".join(some) + b" ", np.uint8).astype(np.uint64) + np.uint64(1)
        place = np.arange(data.size) - np.repeat(starts, lengths)
        out[at:at + SLICE] = mix64(np.add.reduceat(data * _powers_to(int(lengths.max()))[place], starts))
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k word hashes; runs of different k never share a formula."""
    n = max(0, words.size - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * BASE + words[j:j + n]
    return mix64(out)


def grouped(texts: list[list[bytes]], size: int = SLICE) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """(first text, past the last, their words in one list, text of each word): short texts are hashed together."""
    first, words, counts = 0, [], []
    for i, own in enumerate(texts):
        if words and len(words) + len(own) > size:
            yield first, i, words, np.repeat(np.arange(first, i), counts)
            first, words, counts = i, [], []
        words = words + own if words else own
        counts.append(len(own))
    if counts:
        yield first, len(texts), words, np.repeat(np.arange(first, len(texts)), counts)
