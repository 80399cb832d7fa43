"""Elias-Fano sequences and an n-gram trie over them, in one memory-mapped file."""

import tempfile

import numpy as np


class EliasFano:
    """A non-decreasing sequence of unsigned longs: low bits packed, high bits as gaps in a bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        #: The eight bytes from each byte on.
        self.longs = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), shape=(len(low) - 7,), strides=(1,), writeable=False)
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        #: High parts of all elements, and where each high part begins.
        self.tops = (ones - np.arange(n)).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.tops.astype(np.int64), minlength=1)), [n]])

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        if n and top >> low_bits > 64 * n + 1024:
            low_bits = max(low_bits, (top // (32 * n)).bit_length())
        low_bits = min(low_bits, 56)
        bits = [np.unpackbits(values[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits].ravel() for a in range(0, n, 65536)]
        low = np.packbits(np.concatenate(bits) if bits else np.zeros(0, np.uint8), bitorder="little")
        low = np.concatenate([low, np.zeros(8, np.uint8)])
        highs = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(highs[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[highs] = 1
        return n, low_bits, low, np.packbits(flags, bitorder="little")

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        raw = self.longs[bit >> 3]
        return (raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1) if self.low_bits <= 56 else raw

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.tops[at] << np.uint64(self.low_bits)) | self.lows(at)

    def successor(self, values: np.ndarray, lo=None, hi=None) -> np.ndarray:
        """Position of the first element >= each value, within [lo, hi) of each if given."""
        values = np.asarray(values, dtype=np.uint64)
        tops = values >> np.uint64(self.low_bits)
        tops = np.minimum(tops, np.uint64(len(self.first) - 2)).astype(np.int64)
        at, end = self.first[tops], self.first[tops + 1]
        if lo is not None:
            at, end = np.clip(at, lo, hi), np.clip(end, lo, hi)
        want = values & np.uint64((1 << self.low_bits) - 1)
        while True:  # bisection among elements with the same high part
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                return at
            mid = (at[open_] + end[open_]) // 2
            less = self.lows(mid) < want[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end[open_] = np.where(less, end[open_], mid)


class Quantised:
    """Doubles as 16-bit steps of their range."""

    def __init__(self, codes: np.ndarray, low: float, step: float):
        self.codes, self.low, self.step = codes, low, step

    @staticmethod
    def pack(values: np.ndarray) -> tuple[np.ndarray, float, float]:
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        return np.round((values - low) / step).astype(np.uint16), low, step

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.low + self.step * self.codes[at]


class Trie:
    """Level 1 holds predicted words; level k + 1 holds, below a node of level k, the words that stand k before the predicted one.

    A level is one monotone sequence of parent * contexts + context number; a node's children lie between two monotone
    pointers, so a lookup is a successor search relative to the node. Each node has quantised values.
    """

    def __init__(self, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], values: list[list[np.ndarray]]):
        """words: sorted distinct hashes; levels: (parents, contexts) of levels 2 and on, in order of (parent, context hash);
        values: for each level the arrays that its nodes hold."""
        packs, quant, self.spans, above = {("words", 0): EliasFano.pack(words)}, {}, [], len(words)
        for k, (parents, contexts) in enumerate(levels):
            known, number = np.unique(contexts, return_inverse=True)
            self.spans.append(max(1, len(known)))
            packs["known", k] = EliasFano.pack(known)
            packs["pointers", k] = EliasFano.pack(np.searchsorted(parents, np.arange(above + 1)))
            packs["nodes", k] = EliasFano.pack(parents.astype(np.uint64) * np.uint64(self.spans[-1]) + number.astype(np.uint64))
            above = len(contexts)
        for k, arrays in enumerate(values):
            for i, a in enumerate(arrays):
                quant[k, i] = Quantised.pack(a)
        self.file = tempfile.TemporaryFile()  # has no name, so nothing is left behind
        where, at = {}, 0
        for name, arrays in [(k, p[2:]) for k, p in packs.items()] + [(k, p[:1]) for k, p in quant.items()]:
            for i, a in enumerate(arrays):
                pad = -at % 8
                self.file.write(b"\0" * pad + a.tobytes())
                where[name, i] = (at + pad, len(a), a.dtype)
                at += pad + a.nbytes
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.bytes = at
        flat = np.memmap(self.file, dtype=np.uint8, mode="r", shape=(at + 8,))
        part = lambda key: flat[(w := where[key])[0] : w[0] + w[1] * w[2].itemsize].view(w[2])
        self.packs = {k: EliasFano(p[0], p[1], part((k, 0)), part((k, 1))) for k, p in packs.items()}
        self.quant = {k: Quantised(part((k, 0)), p[1], p[2]) for k, p in quant.items()}

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Nodes of words on level 1, -1 for unknown ones."""
        words = self.packs["words", 0]
        at = words.successor(hashes)
        ok = at < words.n
        ok[ok] = words.get(at[ok]) == hashes[ok]
        return np.where(ok, at, -1)

    def find_children(self, level: int, at: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Nodes of level + 1 below the nodes `at` of a level (no -1) by context hashes, -1 for unknown ones."""
        known, pointers, nodes = (self.packs[n, level - 1] for n in ("known", "pointers", "nodes"))
        out = np.full(len(at), -1, dtype=np.int64)
        number = known.successor(contexts)
        ok = np.flatnonzero(number < known.n)
        ok = ok[known.get(number[ok]) == contexts[ok]]
        if len(ok):
            want = at[ok].astype(np.uint64) * np.uint64(self.spans[level - 1]) + number[ok].astype(np.uint64)
            lo, hi = pointers.get(at[ok]).astype(np.int64), pointers.get(at[ok] + 1).astype(np.int64)
            p = nodes.successor(want, lo, hi)
            hit = np.flatnonzero(p < hi)
            hit = hit[nodes.get(p[hit]) == want[hit]]
            out[ok[hit]] = p[hit]
        return out

    def value(self, level: int, which: int, at: np.ndarray) -> np.ndarray:
        return self.quant[level - 1, which].get(at)

    def close(self):
        del self.packs, self.quant
        self.file.close()
