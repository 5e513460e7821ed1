"""Words and windows of many texts at once, as 64-bit hashes, with numpy.

A word's bytes are folded 8 at a time through a mixing step that isn't linear; windows of words are folded pairwise, as in a tree.
So neither has the algebraic collisions that polynomials modulo 2**64 have (Thue-Morse strings), and a seed drawn by each job makes
collisions that were built on purpose useless. What acts on equal windows compares their contents all the same.
"""

from __future__ import annotations

import secrets

import numpy as np
import xxhash

_B = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_B_INV = pow(_B, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_POWERS: dict[int, np.ndarray] = {}
#: Longer words are hashed one by one.
LONG_WORD = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def job_seed() -> int:
    return secrets.randbits(63)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, at least."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        known = np.full(size, np.uint64(base))
        known[0] = 1
        np.cumprod(known, out=known)
        if size <= 1 << 22:
            _POWERS[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for each pair. Equal contents give equal hashes; different ones may, too, and some strings do so by
    construction: only to put what may be equal side by side, to be compared."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_B, n)[:n], out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= powers(_B_INV, n + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64) * _K1)


def same_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, step: int = 4_000_000) -> np.ndarray:
    """Is values[a:a+size] equal to values[b:b+size], for each triple? In blocks of about step values."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, side="right")))
        if high == low + 1:  # it may be long
            for k in range(0, int(sizes[low]), step):
                to = min(k + step, int(sizes[low]))
                if not np.array_equal(values[a[low] + k : a[low] + to], values[b[low] + k : b[low] + to]):
                    out[low] = False
                    break
        else:
            own = sizes[low:high]
            firsts = np.cumsum(own) - own
            inside = np.arange(int(own.sum())) - np.repeat(firsts, own)
            differ = values[np.repeat(a[low:high], own) + inside] != values[np.repeat(b[low:high], own) + inside]
            wrong = np.unique(np.repeat(np.arange(low, high), own)[differ])
            out[wrong] = False
        low = high
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each data[start:end], by content alone."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(sizes.astype(np.uint64) * _K1 + np.uint64(seed))
    h = mix(h * _K2 + (eight[starts] & _MASKS[np.minimum(sizes, 8)]))
    active, off = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
    while len(active):
        left = sizes[active] - off
        h[active] = mix(h[active] * _K2 + (eight[starts[active] + off] & _MASKS[np.minimum(left, 8)]))
        active, off = active[left > 8], off + 8
    for k in np.flatnonzero(sizes > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return h


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K2 + (b ^ _K3))


def hash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of h[i : i + size] for each i."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, out, done, span = h, None, 0, 1
    while True:
        if size & span:
            part = level[done : done + n]
            out = part if out is None else _both(out, part)
            done += span
        if 2 * span > size:
            break
        level = _both(level[:-span], level[span:])
        span *= 2
    return mix(out + np.uint64(size * int(_K1) % 2**64))


def word_edges(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a space, as bytes; first and end byte of each word; the number of each text's first word, with the total at
    the end."""
    joined = b" ".join(texts)
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    firsts = np.searchsorted(starts, at)
    firsts[-1] = len(starts)
    return data, starts, ends, firsts


def words(texts: list[bytes], seed: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of each text's first word, with the total at the end."""
    data, starts, ends, firsts = word_edges(texts, lower)
    return (hash_words(data, starts, ends, seed) if len(starts) else np.zeros(0, np.uint64)), firsts


def shingles(texts: list[bytes], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every n-word shingle of the lower-cased texts, repeats included; a text with 1 to n - 1 words
    has one, of all its words."""
    w, firsts = words(texts, seed, lower=True)
    counts = np.diff(firsts)
    per = np.maximum(counts - n + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    every = hash_windows(w, n)
    start = np.repeat(firsts[:-1] - (np.cumsum(per) - per), per) + np.arange(len(owner))
    h = [every[start]] if len(owner) else []
    owners = [owner]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            h.append(hash_windows(w, size)[firsts[short]])
            owners.append(short)
    return (np.concatenate(h) if h else np.zeros(0, np.uint64)), np.concatenate(owners)


def chunks(texts: list, limit: int):
    """Slices of the list of about limit bytes; a longer text is alone."""
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= limit:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to
