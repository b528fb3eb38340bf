"""Elias-Fano sequences over memory-mapped arrays, with array-at-a-time access and search."""

from __future__ import annotations

import json

import numpy as np

#: For each byte and rank: the place of that set bit, 8 where there is none.
SELECT = np.full((256, 8), 8, np.uint8)
for _v in range(256):
    _bits = [b for b in range(8) if _v >> b & 1]
    SELECT[_v, : len(_bits)] = _bits
ONE = np.uint64(1)


def pack(arrays: dict[str, np.ndarray], **meta) -> bytes:
    """Named arrays behind a JSON header, each at a multiple of 64 bytes."""
    table, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        table[name] = [x.dtype.str, len(x), at]
        pad = -len(raw) % 64
        parts += [raw, b"\0" * pad]
        at += len(raw) + pad
    head = json.dumps({"arrays": table, "meta": meta}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def unpack(data: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    """Views into what pack wrote; nothing is copied."""
    size = int.from_bytes(bytes(data[:8]), "little")
    head = json.loads(bytes(data[8 : 8 + size]))
    out = {}
    for name, (kind, n, at) in head["arrays"].items():
        kind = np.dtype(kind)
        begin = 8 + size + at
        out[name] = np.asarray(data[begin : begin + n * kind.itemsize]).view(kind)
    return out, head["meta"]


def build(x: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and figures of the code of x, ascending numbers below universe."""
    x = np.asarray(x, np.uint64)
    n = len(x)
    bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    low = []
    for lo in range(0, n, 1 << 18) if bits else ():
        part = np.unpackbits(np.ascontiguousarray(x[lo : lo + (1 << 18)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        low.append(np.packbits(np.ascontiguousarray(part).ravel(), bitorder="little"))
    low = np.concatenate([*low, np.zeros(16, np.uint8)])
    low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)]).view(np.uint64)
    length = n + (universe >> bits) + 2
    marks = np.zeros(-(-length // 512) * 512, bool)
    marks[(x >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
    high = np.packbits(marks, bitorder="little").view(np.uint64)
    words = marks.reshape(-1, 8, 64).sum(axis=2)
    ones = np.append(0, np.cumsum(words.sum(axis=1)))
    part = np.cumsum(words, axis=1) - words
    return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones.astype(np.uint64), f"{name}.part": part.ravel().astype(np.uint16)}, {f"{name}.n": n, f"{name}.bits": bits}


class Sequence:
    """A coded sequence, as views into a file."""

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict, name: str):
        self.low, self.high, ones, self.part = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "part"))
        self.n, self.bits = meta[f"{name}.n"], meta[f"{name}.bits"]
        self.ones = ones.astype(np.int64)
        self.zeros = np.arange(len(self.ones)) * 512 - self.ones
        self.mask = np.uint64((1 << self.bits) - 1)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.low[word] >> shift | self.low[word + 1] << ONE << (np.uint64(63) - shift)) & self.mask

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Where the rank-th (from 0) one, or zero, stands in the high bits."""
        before = self.ones if ones else self.zeros
        block = np.searchsorted(before, rank, side="right") - 1
        left = (rank - before[block]).astype(np.int64)
        # Halve the block's eight words by their stored counts, then the word by its own, down to a byte.
        at = block * 8
        for step in (4, 2, 1):
            here = self.part[at + step].astype(np.int64)
            at += step * ((here if ones else (at + step & 7) * 64 - here) <= left)
        here = self.part[at].astype(np.int64)
        left -= here if ones else (at & 7) * 64 - here
        word = self.high[at] if ones else ~self.high[at]
        place = at * 64
        for width in (32, 16, 8):
            here = np.bitwise_count(word & np.uint64((1 << width) - 1))
            on = here <= left
            left -= here * on
            place += width * on
            word = word >> (on * np.uint64(width))
        return place + SELECT[word & np.uint64(255), left]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits) | self._lows(i)

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 high bits from place at; zeros or others behind the last word."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return self.high[word] >> shift | self.high[np.minimum(word + 1, len(self.high) - 1)] << ONE << (np.uint64(63) - shift)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places i and those at i + 1."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        place = self._select(i, True)
        ahead = self._window(place + 1)
        after = place + 1 + np.bitwise_count(~ahead & (ahead - ONE))
        far = np.flatnonzero(ahead == 0)
        if len(far):
            after[far] = self._select(i[far] + 1, True)
        bits = np.uint64(self.bits)
        return (place - i).astype(np.uint64) << bits | self._lows(i), (after - i - 1).astype(np.uint64) << bits | self._lows(i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of numbers x, -1 where one is not in the sequence."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = x >> np.uint64(self.bits)
        q = np.flatnonzero(h < np.uint64(self.zeros[-1]))
        h, want = h[q].astype(np.int64), (x & self.mask)[q]
        place = np.full(len(q), -1, np.int64)
        inner = h > 0
        if inner.all():
            place = self._select(h - 1, False)
        else:
            place[inner] = self._select(h[inner] - 1, False)
        i = place - h + 1
        place += 1
        while len(q):
            # As many numbers of the same high bits follow as ones do; a run may pass the window.
            ahead = self._window(place)
            run = np.bitwise_count(ahead & ~(ahead + ONE)).astype(np.int64)
            at = np.flatnonzero(run)
            k = 0
            while len(at):
                low = self._lows(i[at] + k)
                same = low == want[at]
                out[q[at[same]]] = i[at[same]] + k
                k += 1
                at = at[(low < want[at]) & (run[at] > k)]
            long = np.flatnonzero(run == 64)
            long = long[out[q[long]] < 0]
            q, want, place, i = q[long], want[long], place[long] + 64, i[long] + 64
        return out
