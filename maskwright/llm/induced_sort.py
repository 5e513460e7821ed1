"""Suffix order by induced sorting in bulk, with queues that spill to disk.

The priority queue of induced sorting holds suffixes keyed by (first symbol, order of arrival). So it is a FIFO queue per
symbol: what arrives stays in order, and a bucket is taken out whole. Suffixes of a bucket are induced together, with
one bulk step per generation of suffixes that stay in it. Queues beyond the memory budget go to one temporary file.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .tokens import same_spans

#: With more symbols than this, buckets are too small to be handled in bulk, and the reduced string is sorted by prefix doubling.
MAX_SYMBOLS = 4096


class BucketQueues:
    """Queues of positions per symbol. Beyond budget bytes in memory, arrays move to a file that goes with the object."""

    def __init__(self, symbols: int, budget: int) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        """In order; positions of one symbol keep theirs."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        positions, symbols = positions[order], symbols[order]
        cut = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for s, part in zip(symbols[cut].tolist(), np.split(positions, cut[1:])):
            self.parts[s].append(part)
        self.held += positions.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.tell(), len(part), part.dtype)
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        parts, self.parts[symbol] = self.parts[symbol], []
        out = []
        for part in parts:
            if isinstance(part, tuple):
                at, n, kind = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(n * kind.itemsize), kind)
            else:
                self.held -= part.nbytes
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them; the last symbol is unique and the least."""
    n = len(t)
    edge = np.flatnonzero(t[1:] != t[:-1])  # ends of runs but the last
    up = t[edge] < t[edge + 1]
    sizes = np.diff(np.r_[-1, edge, n - 1])
    return np.repeat(np.r_[up, True], sizes)


def induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, budget: int) -> np.ndarray:
    """All suffixes in order, given the seeds (left-most small ones) in order. With seeds in text order within each symbol,
    the seeds' own order comes out by the substring up to the next seed."""
    at = np.searchsorted(t[seeds], np.arange(symbols + 1))
    queue = BucketQueues(symbols, budget)
    large: list[np.ndarray] = []

    def before(x: np.ndarray, kind: bool) -> np.ndarray:
        p = x[x > 0] - 1
        return p[small[p] == kind]

    for c in range(symbols):
        front, done = queue.pop(c), []
        while len(front):
            done.append(front)
            p = before(front, False)
            s = t[p]
            stay = s == c
            front = p[stay]
            queue.push(p[~stay], s[~stay])
        large.append(np.concatenate(done) if done else np.zeros(0, np.int32))
        p = before(seeds[at[c] : at[c + 1]], False)
        queue.push(p, t[p])
    queue = BucketQueues(symbols, budget)
    queue.push(np.array([len(t) - 1], np.int32), np.zeros(1, t.dtype))
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        front, done = queue.pop(c), []
        while len(front):
            done.append(front)
            p = before(front, True)
            s = t[p]
            stay = s == c
            front = p[stay]
            queue.push(p[~stay], s[~stay])
        p = before(large[c][::-1], True)
        queue.push(p, t[p])
        if done:
            out.append(np.concatenate(done)[::-1])
        out.append(large[c])
        large[c] = large[c][:0]
    return np.concatenate(out[::-1])


def doubled(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by prefix doubling; suffixes that agree in depth symbols may come in any order."""
    rank, k, n = t.astype(np.int64), 1, len(t)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        k *= 2
        new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        if new[-1] == n - 1 or k >= min(depth, n):
            return order.astype(np.int32)
        rank[order] = new


def suffix_order(t: np.ndarray, depth: int, budget: int = 64_000_000) -> np.ndarray:
    """The suffixes of t, whose last symbol is 0 and occurs nowhere else, in order. Suffixes that agree in depth symbols may come
    in any order."""
    symbols = int(t.max()) + 1
    if len(t) < 3 or symbols > MAX_SYMBOLS:
        return doubled(t, depth)
    small = types(t)
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    first = seeds[np.argsort(t[seeds], kind="stable")]
    order = induce(t, small, first, symbols, budget)
    is_seed = np.zeros(len(t), bool)
    is_seed[seeds] = True
    ranked = order[is_seed[order]]
    # Names of the substrings from seed to seed: neighbours in order are compared symbol by symbol.
    number = np.searchsorted(seeds, ranked)
    sizes = np.r_[seeds[1:], seeds[-1]][number] + 1 - ranked
    equal = sizes[1:] == sizes[:-1]
    at = np.flatnonzero(equal)
    equal[at] = same_spans(t, ranked[:-1][at].astype(np.int64), ranked[1:][at].astype(np.int64), sizes[1:][at].astype(np.int64))
    names = np.cumsum(np.r_[0, ~equal])
    if names[-1] < len(seeds) - 1:
        reduced = np.empty(len(seeds), np.int32)
        reduced[number] = names
        if int(names[-1]) < 2**16:
            reduced = reduced.astype(np.uint16)
        ranked = seeds[suffix_order(reduced, depth, budget)]
    return induce(t, small, ranked, symbols, budget)
