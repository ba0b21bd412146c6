"""Elias-Fano sequences over memory-mapped bytes, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

#: Unary bits of a block whose zeros are counted.
_BLOCK = 256


def _bits(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits (57 of them valid for any alignment) that begin at bit positions `at`."""
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    return words[at >> 3] >> (at & 7).astype(np.uint64)


class EliasFano:
    """An ascending sequence: low bits packed, high bits in unary, and the zeros before each block of them."""

    def __init__(self, n: int, low: int, most: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.most, self.lows, self.highs, self.zeros = n, low, most, lows, highs, zeros

    @classmethod
    def build(cls, values: np.ndarray, low: int | None = None) -> EliasFano:
        """low: bits kept packed; 0 makes a unary list of how many values each number has."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = low if low is not None else min(57, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        size = n * low
        lows = np.zeros((size >> 3) + 16, np.uint8)
        if low:
            for i in range(0, n, 1 << 18):  # bit by bit, in blocks that keep the matrix small
                part = values[i : i + (1 << 18)]
                bit = ((part[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bit.reshape(-1), bitorder="little")
                lows[i * low >> 3 : (i * low >> 3) + len(packed)] = packed
        high = (values >> np.uint64(low)).astype(np.int64)
        span = n + (int(high[-1]) if n else 0) + 2
        flags = np.zeros(span, bool)
        flags[high + np.arange(n)] = True
        highs = np.concatenate([np.packbits(flags, bitorder="little"), np.zeros(16, np.uint8)])
        each = np.add.reduceat((~flags).astype(np.int32), np.arange(0, span, _BLOCK))
        zeros = np.concatenate([[0], np.cumsum(each, dtype=np.int64)[:-1]]).astype(np.uint32 if span < 1 << 32 else np.uint64)
        return cls(n, low, int(high[-1]) if n else 0, lows, highs, zeros)

    def nbytes(self) -> int:
        return self.lows.nbytes + self.highs.nbytes + self.zeros.nbytes

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of zero number k of the unary bits."""
        block = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        pos = block * _BLOCK
        left = k - self.zeros[block].astype(np.int64)
        live = np.arange(len(k))
        out = pos.copy()
        mask = np.uint64((1 << 56) - 1)
        at, need = pos, left
        while len(live):
            w = ~_bits(self.highs, np.minimum(at, (len(self.highs) - 8) * 8)) & mask
            got = np.bitwise_count(w).astype(np.int64)
            inside = need < got
            if inside.any():
                x, r, p = w[inside], need[inside], at[inside]
                for half in (32, 16, 8, 4, 2, 1):
                    lower = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
                    up = r >= lower
                    r = np.where(up, r - lower, r)
                    p = np.where(up, p + half, p)
                    x = np.where(up, x >> np.uint64(half), x)
                out[live[inside]] = p
            live, at, need = live[~inside], at[~inside] + 56, (need - got)[~inside]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        return _bits(self.lows, i * self.low) & np.uint64((1 << self.low) - 1)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the values whose high bits are `high`."""
        at = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        begin = at - high
        # as many values as ones follow; only long runs need the next zero itself
        word = ~_bits(self.highs, at) & np.uint64((1 << 56) - 1)
        run = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end = begin + run
        if (far := np.flatnonzero(word == 0)).size:
            end[far] = self._zero(high[far]) - high[far]
        return begin, end

    def find(self, keys: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, or -1. begin, end: the range of its context, to which the successor search keeps."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        keys = keys.astype(np.uint64)
        high = keys >> np.uint64(self.low)
        out_of = high > np.uint64(self.most)
        a, b = self.bucket(np.minimum(high, np.uint64(self.most)).astype(np.int64))
        if begin is not None:
            a, b = np.maximum(a, begin), np.minimum(b, end)
        b = np.where(out_of, a, b)
        target = keys & np.uint64((1 << self.low) - 1)
        stop = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < target[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        ok = a < stop
        ok[ok] = self._low(a[ok]) == target[ok]
        return np.where(ok, a, -1)

    def parts(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.low, self.most], np.int64), "lows": self.lows, "highs": self.highs, "zeros": self.zeros}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        n, low, most = parts["meta"].tolist()
        return cls(n, low, most, parts["lows"], parts["highs"], parts["zeros"])


def save(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one block: a head with name, type, place and size of each, then their bytes."""
    head, body, at = [], [], 0
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        pad = -len(raw) % 8
        head.append(f"{k} {a.dtype.str} {at} {len(a)}")
        body += [raw, b"\0" * pad]
        at += len(raw) + pad
    text = "\n".join(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def load(raw: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of save() as views of raw (bytes in memory or a mapped file)."""
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for line in raw[8 : 8 + n].tobytes().decode().strip().split("\n"):
        k, kind, at, size = line.split()
        width = np.dtype(kind).itemsize
        out[k] = raw[8 + n + int(at) : 8 + n + int(at) + int(size) * width].view(kind)
    return out
