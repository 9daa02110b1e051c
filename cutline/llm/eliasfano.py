"""Elias-Fano coded monotone sequences in memory-mapped files, queried in batches."""

import os
import uuid

import numpy as np

_ONE, _LOW6 = np.uint64(1), np.uint64(63)


def _select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each 64-bit word."""
    at, k = np.zeros(words.size, np.uint64), k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.uint64)
        right = k >= ones
        k = np.where(right, k - ones, k)
        words = np.where(right, words >> np.uint64(width), words)
        at += right.astype(np.uint64) * np.uint64(width)
    return at.astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of n unsigned numbers: low bits packed side by side, high parts as gaps in unary.

    ``ones`` and ``zeros`` count the set and clear bits before each 64-bit word, so the i-th value and the bucket of a
    high part are found by one search and a select inside a word.
    """

    PARTS = ("head", "low", "high", "ones", "zeros")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.shift = (int(x) for x in parts["head"])
        self.low, self.high, self.ones, self.zeros = (parts[k] for k in self.PARTS[1:])
        self._mask = np.uint64((1 << self.shift) - 1)

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = values.size
        top = int(values[-1]) if n else 0
        shift = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * shift // 8 + 9, np.uint8)
        if shift:
            size = 1 << 16
            for i in range(0, n, size):  # 65,536 numbers fill whole bytes at any width
                bits = np.unpackbits((values[i:i + size] & np.uint64((1 << shift) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :shift]
                packed = np.packbits(bits.ravel(), bitorder="little")
                low[i * shift // 8:i * shift // 8 + packed.size] = packed
        place = (values >> np.uint64(shift)) + np.arange(n, dtype=np.uint64)
        words = ((top >> shift) + n) // 64 + 1
        high = np.zeros(words, np.uint64)
        if n:
            word = (place >> np.uint64(6)).astype(np.int64)
            first = np.append(0, np.nonzero(np.diff(word))[0] + 1)
            high[word[first]] = np.bitwise_or.reduceat(_ONE << (place & _LOW6), first)
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))
        return {"head": np.array([n, shift], np.int64), "low": low, "high": high, "ones": ones[:-1], "zeros": np.arange(words, dtype=np.int64) * 64 - ones[:-1]}

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_words(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.shift)) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(i.size, np.uint64)
        bit = i * self.shift
        windows = np.lib.stride_tricks.sliding_window_view(self.low, 8)
        return (windows[bit >> 3].view("<u8").ravel() >> (bit & 7).astype(np.uint64)) & self._mask

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        zero = high - 1
        word = np.searchsorted(self.zeros, zero, "right") - 1
        word = np.maximum(word, 0)
        place = word * 64 + _select_in_words(~self.high[word], np.maximum(zero, 0) - self.zeros[word])
        return np.where(high > 0, place - zero, 0)

    def successor(self, target: np.ndarray) -> np.ndarray:
        """Index of the first value at or above each target; n where there is none."""
        target = np.asarray(target, np.uint64)
        a = np.full(target.size, self.n, np.int64)
        if not self.n or not target.size:
            return a
        high = target >> np.uint64(self.shift)
        inside = high <= self[np.array([self.n - 1])][0] >> np.uint64(self.shift)
        h, t = high[inside].astype(np.int64), target[inside] & self._mask
        lo, hi = self._before(h), np.minimum(self._before(h + 1), self.n)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = np.zeros(lo.size, bool)
            less[open_] = self._lows(mid[open_]) < t[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        a[inside] = lo
        return a

    def find(self, target: np.ndarray) -> np.ndarray:
        """Index of each target, -1 where it is not in the sequence."""
        target = np.asarray(target, np.uint64)
        at = self.successor(target)
        hit = at < self.n
        out = np.full(target.size, -1, np.int64)
        hit[hit] = self[at[hit]] == target[hit]
        out[hit] = at[hit]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays to one file; it appears under its name only when complete, so attempts may repeat."""
    own = f"{path}.{uuid.uuid4().hex}"
    head, at, body = [], 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array)
        head.append(f"{name} {data.dtype.str} {at} {data.size}")
        pad = -data.nbytes % 8
        body += [data.tobytes(), b"\0" * pad]
        at += data.nbytes + pad
    text = "\n".join(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    with open(own, "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text + b"".join(body))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views of its memory map; pages are read when touched."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for line in data[8:8 + size].tobytes().decode().strip().split("\n"):
        name, kind, at, n = line.split()
        kind, at = np.dtype(kind), 8 + size + int(at)
        out[name] = np.frombuffer(data, kind, int(n), at) if int(n) else np.zeros(0, kind)
    return out


def prefixed(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in EliasFano.PARTS})
