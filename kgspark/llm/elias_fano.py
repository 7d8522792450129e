"""Monotone integers in Elias-Fano form, as numpy arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

_SELECT = np.zeros((256, 9), np.uint8)  # place of the k-th one of a byte
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p


def _padded(bits: bytes) -> bytes:
    return bits + bytes(-len(bits) % 8 + 8)


class EliasFano:
    """values[i] = high part, by the place of the i-th one of a bit vector, and low part, of `low` bits."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.highs, self.ones, self.zeros = n, low, highs, ones, zeros
        self.lows = np.ndarray((max(0, len(lows) - 7),), "<u8", lows, strides=(1,))

    @staticmethod
    def coded(values: np.ndarray) -> bytes:
        """values: sorted, not negative, fewer than 2**31. Header of four 64-bit integers, low bits, high bits, ones and zeros before each word."""
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        part = [np.packbits(((v[k : k + (1 << 18)] & np.uint64((1 << low) - 1))[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, n, 1 << 18)] if low else []
        lows = _padded(b"".join(p.tobytes() for p in part))
        bits = np.zeros(n + (top >> low) + 2, np.uint8)
        bits[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        highs = _padded(np.packbits(bits, bitorder="little").tobytes())
        words = np.frombuffer(highs, "<u8")
        ones = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words)[:-1], out=ones[1:])
        return np.array([n, low, len(lows), len(highs)], "<i8").tobytes() + lows + highs + ones.astype("<u4").tobytes() + (np.arange(len(ones)) * 64 - ones).astype("<u4").tobytes()

    @classmethod
    def at(cls, raw: np.ndarray) -> tuple[EliasFano, int]:
        """From bytes, whose rest may be anything; and the number of bytes used."""
        n, low, a, b = raw[:32].view("<i8").tolist()
        words = b // 8
        c = 32 + a + b
        ones, zeros = (raw[c + 4 * k * words : c + 4 * (k + 1) * words].view("<u4") for k in (0, 1))
        return cls(n, low, raw[32 : 32 + a], raw[32 + a : c].view("<u8"), ones, zeros), c + 8 * words

    @staticmethod
    def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of each 64-bit word: the half that holds it, three times, then a table for the byte left."""
        place, k = np.zeros(len(k), np.int64), k.copy()
        for half in (32, 16, 8):
            count = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
            up = k >= count
            k -= count * up
            words = words >> (up.astype(np.uint64) * np.uint64(half))
            place += up * half
        return place + _SELECT[(words & np.uint64(255)).astype(np.int64), k]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        p = i * self.low
        return (self.lows[p >> 3] >> (p & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.int64)
        w = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = w * 64 + self._in_word(self.highs[w], i - self.ones[w])
        return (place - i) << self.low | self._lows(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        w = np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1
        return w * 64 + self._in_word(~self.highs[w], k - self.zeros[w])

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of a high part begin and end: after the ones before the high-th zero, by as many ones as follow it."""
        after = np.zeros(len(high), np.int64)  # the place in the high bits where the ones begin
        some = np.flatnonzero(high > 0)
        after[some] = self._zero(high[some] - 1) + 1
        first = after - high
        rest = ~(self.highs[after >> 6] >> (after & 63).astype(np.uint64))
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        over = np.flatnonzero((after & 63) + run >= 64)  # the run may go on in the next word
        if len(over):
            run[over] = self._zero(high[over]) - after[over]
        return first, np.minimum(first + run, self.n)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: successor search within the values of its high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        last = int(self.get(np.array([self.n - 1]))[0])
        ok = np.flatnonzero((values >= 0) & (values <= last))
        high, low = values[ok] >> self.low, values[ok] & ((1 << self.low) - 1)
        lo, end = self._bucket(high)
        hi = end
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi = hi.copy() if hi is end else hi
            hi[open_[~less]] = mid[~less]
        found = np.flatnonzero(lo < end)
        same = found[self._lows(lo[found]) == low[found]]
        out[ok[same]] = lo[same]
        return out
