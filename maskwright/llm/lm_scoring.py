"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy inside Spark tasks.

A token is a word or the end of a text, and a text is the subword ids of its words, one after the other, and the end's. Its probability is the product of
P(id | ids before), each of which the attention model predicts: no word, and no part of one, gets its share from counts.

Ids are told apart by rank, the most frequent in training texts first. The softmax over all of the vocabulary has two levels, both of what attention
made of the ids before: the class, then the id within its class. The first ranks are classes of their own, later classes are ranges of ranks that grow.

Jobs, each of which leaves a table in the shared folder:
1. Blocks: texts as word numbers, with the block's different words and their training counts. A word is one row a block from here on, however often it occurs.
2. Counts by word, and from each word's subword ids the counts of ids, hence their ranks. What the driver gets is bounded by the tokenizer's vocabulary.
3. Each block's words get their count and the ranks of their ids by a join.
4. Training in ROUNDS rounds, each over its share of the blocks, so every id of a training text counts once: every block takes Adam steps of its own from
   the shared weights, and the weights' average by ids is the next round's start.
5. Scoring: windows of WINDOW ids, each STRIDE after the last; an id is scored in the first window that holds it, with what the window
   has before it as context, and masked attention over batches of windows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, real_id, scratch_path, table, tidy
from .exchange import planes, unplanes

#: The token at the end of each text; no word holds white space.
END_WORD = b"\n"
#: Tokens of a block, about; a longer text is cut, and its parts are scored one by one.
BLOCK = 4_000_000
#: A block's number is its partition's, moved by so many bits, and its own among the partition's.
PARTITION_BITS = 33
#: What the model tells apart: subword ids by rank, and how far into its word an id is. (SPELL_CLASSES: of Lexicon alone.)
CLASSES, OWN_CLASS, LAST_CLASSES, SPELL_CLASSES = 50257, 40, 64, 128
#: A class of later ranks holds this share of the ranks before it, up to a limit.
GROWTH, MOST = 0.6, 4096
WIDTH, HEADS, WINDOW, STRIDE = 16, 2, 64, 48
ROUNDS, RATES, BATCH = 4, (0.01, 0.007, 0.004, 0.002), 2048
#: Steps that a block takes at least, by smaller batches, and places of the smallest.
STEPS, LEAST_BATCH = 128, 256
_ONES = np.ones(MOST, np.float32)
DISCOUNT, SPREAD, LEAST = 0.6, 10.0, 0.5
#: Weights that are averaged as one row, and ids that are laid out at a time.
CELLS_A_ROW, SLICE = 4096, 500_000
_BLOCKS = "block long, words array<binary>, train array<int>, rows array<long>, held array<boolean>, sizes array<int>, places binary"
#: What a block holds of its words, and as which numbers: their counts, their numbers of subwords and, one after the other, the subwords' ranks.
_WORD = {"count": "<i8", "pieces": "<u4", "ranks": "<u4"}
_TOLD = "block long, rows array<long>, held array<boolean>, sizes array<int>, places binary, count binary, pieces binary, ranks binary, round int"


# --- blocks -------------------------------------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(values))


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return unplanes(raw, 0, len(raw) // np.dtype(kind).itemsize, kind)[0]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (as bytes.split() does), then the end."""
    return [*text.lower().split(), END_WORD]


def round_of(block: int) -> int:
    """The round that a block is trained in: a partition's blocks, and the nth blocks of all partitions, are dealt out evenly."""
    return ((block >> PARTITION_BITS) + block % (1 << PARTITION_BITS)) % ROUNDS


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << PARTITION_BITS
        made, known, rows, held, parts = 0, _Numbers(), [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal made, known
            places = np.concatenate(parts)
            owner = np.repeat(np.array(held), [len(p) for p in parts])
            train = np.bincount(places[~owner], minlength=len(known)).astype(np.int32)
            one = [[first + made], [list(known)], [train], [list(rows)], [list(held)], [[len(p) for p in parts]], [_packed(places)]]
            types = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
            made, known = made + 1, _Numbers()
            for x in (rows, held, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, types)], names=["block", "words", "train", "rows", "held", "sizes", "places"])

        total = 0
        for batch in batches:
            for row, out, text in zip(batch.column("row").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.binary())):
                every = tokens(text.as_py())
                for at in range(0, len(every), size):
                    some = every[at : at + size]
                    if total and total + len(some) > size:
                        yield flush()
                        total = 0
                    parts.append(np.fromiter(map(known.__getitem__, some), np.uint32, len(some)))
                    rows.append(row)
                    held.append(out)
                    total += len(some)
        if total:
            yield flush()
        tidy()

    return run


# --- subwords and their counts ------------------------------------------------------------------

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def subwords(words: list[bytes], path: str, end: int) -> list[np.ndarray]:
    """The ids of each word with a space before it; the end has an id of its own, which no word holds."""
    found = _tokenizer(path).encode_batch_fast([" " + w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return [np.array([end] if w == END_WORD else e.ids, "<u4") for w, e in zip(words, found)]


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = subwords(batch.column("word").to_pylist(), path, end)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("count"), pa.array([i.tobytes() for i in ids], pa.binary())], names=["word", "count", "ids"])

    return run


@dataclass
class _Flat:
    """Words of a batch as one array of ids."""

    count: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    first: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        ends = np.cumsum(self.sizes)
        self.first, self.last = self.ids[ends - self.sizes], self.ids[ends - 1]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Flat:
        raw = batch.column("ids").to_pylist()
        return cls(batch.column("count").to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(r) // 4 for r in raw], np.int64))

    def steps(self, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, id before, id after) of every step inside a word; the last step of each is to stop, the end of the word."""
        n = len(self.sizes)
        owner, ends = np.repeat(np.arange(n), self.sizes), np.cumsum(self.sizes)
        after = np.r_[self.ids[1:], stop][: len(self.ids)].copy()
        after[ends - 1] = stop
        return owner, self.ids, after


@dataclass
class Ranks:
    """Subword ids by falling count of the training texts. Arrays of the vocabulary's size."""

    rank: np.ndarray  # of each id
    counts: np.ndarray  # by rank
    end: int  # the end's rank

    @property
    def trained(self) -> int:
        """Ranks that training texts hold, and the others of their classes."""
        used, edges = int((self.counts > 0).sum()), class_edges(len(self.counts))
        return int(edges[np.searchsorted(edges, used)])

    @property
    def kind(self) -> str:
        return "<u2" if len(self.counts) <= 2**16 else "<u4"

    def packed(self, words: _Flat) -> pa.Array:
        """The ranks of each word's ids, as bytes."""
        data = self.rank[words.ids].astype(self.kind)
        ends = np.r_[0, np.cumsum(words.sizes)] * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(words.sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _id_counts(vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                flat = _Flat.of(batch)
                np.add.at(total, flat.ids, np.repeat(flat.count, flat.sizes))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(total[ids])})

    return run


def ranks(words: DataFrame, vocabulary: int, end: int) -> Ranks:
    """words: (word, count, ids). Equal counts: the smaller id first."""
    got = words.mapInArrow(_id_counts(vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(vocabulary, np.int64)
    rank[order] = np.arange(vocabulary)
    return Ranks(rank, counts[order], int(rank[end]))


# --- attention model ----------------------------------------------------------------------------

def class_edges(vocabulary: int) -> np.ndarray:
    """First rank of each class, and the vocabulary's size."""
    edges = list(range(min(OWN_CLASS, vocabulary)))
    at = len(edges)
    while at < vocabulary:
        edges.append(at)
        at += min(MOST, max(1, int(GROWTH * at)))
    return np.array([*edges, vocabulary])


class _Shares:
    """Softmaxes of rows that come in groups, each over the logits h @ weight + bias of its group; all exponents lie in one array.
    groups: (first row, end, weight, bias); target: of each row, in its group."""

    def __init__(self, h: np.ndarray, groups: list[tuple], target: np.ndarray) -> None:
        self.h, self.groups = h, groups
        sizes = [(end - low, len(bias)) for low, end, _, bias in groups]
        ends = np.cumsum([0, *(n * k for n, k in sizes)]).tolist()
        self.data, self.sums = np.empty(ends[-1], h.dtype), np.empty(len(h), h.dtype)
        self.parts = [self.data[at : at + n * k].reshape(n, k) for at, (n, k) in zip(ends, sizes)]
        self.at = np.concatenate([np.arange(at, at + n * k, k) for at, (n, k) in zip(ends, sizes)] or [target]) + target
        for shift in (False, True):
            for g, (low, end, weight, bias) in zip(self.parts, groups):
                np.matmul(h[low:end], weight, out=g)
                g += bias
                if shift:
                    g -= g.max(1, keepdims=True)
            self.picked = self.data.take(self.at)  # in the end the log share of each row's target
            np.exp(self.data, out=self.data)
            for g, (low, end, *_) in zip(self.parts, groups):
                np.matmul(g, _ONES[: g.shape[1]], out=self.sums[low:end])
            self.picked -= np.log(self.sums)
            # Else exponents were too large, or all too small.
            if np.isfinite(self.picked.sum()):
                break

    def slopes(self, weight: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """For each group: slopes of its logits, its first row and end, if each row's -log share counts by weight. To be called once."""
        scale = (weight / self.sums)[:, None]
        for g, (low, end, *_) in zip(self.parts, self.groups):
            g *= scale[low:end]
        self.data[self.at] -= weight
        return [(g, low, end) for g, (low, end, *_) in zip(self.parts, self.groups)]


def _row_sums(x: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of index, and the sum of x's rows for each."""
    order = np.argsort(index, kind="stable")
    keys = index[order]
    heads = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[heads], np.add.reduceat(x.take(order, 0), heads, axis=0)


class AttentionModel:
    """HEADS heads of causal self-attention over WIDTH numbers a place, with queries, keys and values of their own, and a softmax over all ranks in two levels.
    weights: by name."""

    def __init__(self, flat: np.ndarray, vocabulary: int = CLASSES) -> None:
        self.edges = class_edges(vocabulary)
        self.sizes = np.diff(self.edges)
        self.own = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.w, at = {}, 0
        for name, shape in self.shapes(vocabulary).items():
            n = int(np.prod(shape))
            self.w[name] = flat[at : at + n].astype(np.float32).reshape(shape)
            at += n
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    @staticmethod
    def shapes(vocabulary: int) -> dict[str, tuple[int, ...]]:
        classes, square = len(class_edges(vocabulary)) - 1, (WIDTH, WIDTH)
        small = {"last": (LAST_CLASSES, WIDTH), "place": (WINDOW, WIDTH), "query": square, "key": square, "value": square, "join": square, "out": (WIDTH, classes), "bias": (classes,)}
        return small | {n: (vocabulary, WIDTH) for n in ("first", "inside")} | {"inside_bias": (vocabulary,)}

    @classmethod
    def cells(cls, vocabulary: int) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes(vocabulary).values())

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> np.ndarray:
        """Small random weights, and biases by which the model begins at each rank's share."""
        rng = np.random.default_rng(seed)
        mass, edges = counts + LEAST, class_edges(len(counts))
        total = np.add.reduceat(mass, edges[:-1])
        shapes = cls.shapes(len(counts))
        known = {"out": np.zeros(shapes["out"]), "inside": np.zeros(shapes["inside"]), "bias": np.log(total / total.sum()), "inside_bias": np.log(mass / np.repeat(total, np.diff(edges)))}
        return np.concatenate([(known[n] if n in known else rng.standard_normal(s) * (0.1 if n in ("first", "last", "place") else WIDTH**-0.5)).ravel() for n, s in shapes.items()]).astype(np.float32)

    @classmethod
    def live(cls, vocabulary: int, trained: int) -> np.ndarray:
        """Numbers of the weights that training may change: those of ranks from trained on stay as they are."""
        parts, at = [], 0
        for shape in cls.shapes(vocabulary).values():
            n = int(np.prod(shape))
            parts.append(np.arange(at, at + (n // vocabulary * trained if shape[0] == vocabulary else n)))
            at += n
        return np.concatenate(parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def _wide(self, gap: int = 0) -> np.ndarray:
        """Weights of queries, keys and values side by side; behind each head's values so many columns of zeros."""
        depth = WIDTH // HEADS
        values = np.zeros((WIDTH, HEADS, depth + gap), self.w["value"].dtype)
        values[..., :depth] = self.w["value"].reshape(WIDTH, HEADS, depth)
        return np.concatenate((self.w["query"] * np.float32(depth**-0.5), self.w["key"], values.reshape(WIDTH, -1)), 1)

    def _attend(self, x: np.ndarray, z: np.ndarray):
        w, (m, n) = self.w, x.shape
        depth = WIDTH // HEADS
        e = w["first"].take(x, 0)
        e += w["last"].take(z, 0)
        e += w["place"][:n]
        e = e.reshape(-1, WIDTH)
        # Heads are views of one array, so that nothing is copied.
        three = (e @ self._wide(1)).reshape(m, n, -1)
        q, k, v = (three[..., low:high].reshape(m, n, HEADS, -1).transpose(0, 2, 1, 3) for low, high in ((0, WIDTH), (WIDTH, 2 * WIDTH), (2 * WIDTH, None)))
        v[..., depth] = 1  # these add up the shares
        c = np.empty((m, n, HEADS, depth + 1), e.dtype)
        mask = self.mask[:n, :n]
        for shift in (False, True):
            a = q @ k.transpose(0, 1, 3, 2)
            if shift:
                a -= np.where(mask > 0, a, -np.inf).max(3, keepdims=True)
                np.minimum(a, 0, out=a)
            np.exp(a, out=a)
            a *= mask
            np.matmul(a, v, out=c.transpose(0, 2, 1, 3))
            total = c[..., depth:]
            if 1e-30 < total.min() and total.max() < 1e30:
                break
        joined = (c[..., :depth] / total).reshape(-1, WIDTH)
        h = joined @ w["join"]
        h += e
        return e, q, k, v, a, total, joined, h

    def _inside(self, h: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[int], _Shares]:
        """Places whose class has several ranks, by class; these classes; the shares of the ranks within them."""
        order = np.argsort(own.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(self.sizes) + 1))
        many = np.flatnonzero((np.diff(bounds) > 0) & (self.sizes > 1)).tolist()
        at = np.concatenate([order[bounds[c] : bounds[c + 1]] for c in many] or [order[:0]])
        groups, end = [], 0
        for c in many:
            rows = slice(self.edges[c], self.edges[c + 1])
            low, end = end, end + int(bounds[c + 1] - bounds[c])
            groups.append((low, end, self.w["inside"][rows].T, self.w["inside_bias"][rows]))
        return at, many, _Shares(h.take(at, 0), groups, y[at] - self.edges[own[at]])

    def _classes(self, h: np.ndarray, own: np.ndarray) -> _Shares:
        return _Shares(h, [(0, len(h), self.w["out"], self.w["bias"])], own)

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def log_shares(self, x: np.ndarray, z: np.ndarray, y: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
        """log P(rank y | places up to it); asked: of these places alone, in a row. x, z: rank of the id before each place, and how far into its word that is."""
        h, y_ = self._attend(x, z)[-1], y.ravel()
        if asked is not None:
            some = np.flatnonzero(asked)
            h, y_ = h.take(some, 0), y_.take(some)
        own = self.own[y_]
        out = self._classes(h, own).picked
        at, _, found = self._inside(h, y_, own)
        out[at] += found.picked
        return out.reshape(y.shape) if asked is None else out

    def gradient(self, x: np.ndarray, z: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of -log P over the real places, by name of the weight."""
        out = {}
        for name, (rows, g) in self._slopes(x, z, y, real).items():
            out[name] = np.zeros_like(self.w[name])
            out[name][rows] = g
        return out

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def _slopes(self, x: np.ndarray, z: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, tuple]:
        """gradient() as (rows, their slopes); all other rows have none."""
        w, (m, n), y_ = self.w, x.shape, y.ravel()
        depth = WIDTH // HEADS
        e, q, k, v, a, total, joined, h = self._attend(x, z)
        own = self.own[y_]
        weight = (real.ravel() / max(1, real.sum())).astype(h.dtype)
        g = self._classes(h, own).slopes(weight)[0][0]
        top = int(self.edges[own.max() + 1])
        out = {"bias": np.ones(len(g), g.dtype) @ g, "out": h.T @ g, "inside": np.zeros((top, WIDTH), h.dtype), "inside_bias": np.zeros(top, h.dtype)}
        dh = g @ w["out"].T
        at, many, found = self._inside(h, y_, own)
        back, one = np.empty_like(found.h), np.ones(len(at), h.dtype)
        for c, (g, low, end) in zip(many, found.slopes(weight[at])):
            rows = slice(self.edges[c], self.edges[c + 1])
            np.matmul(g.T, found.h[low:end], out=out["inside"][rows])
            np.matmul(one[low:end], g, out=out["inside_bias"][rows])
            np.matmul(g, w["inside"][rows], out=back[low:end])
        dh[at] += back
        out["join"] = joined.T @ dh
        dc = np.empty((m, n, HEADS, depth + 1), h.dtype)
        some = dh @ w["join"].T
        some /= np.repeat(total.reshape(-1, HEADS), depth, 1)
        dc[..., :depth] = some.reshape(m, n, HEADS, depth)
        some *= joined
        dc[..., depth] = (some.reshape(-1, depth) @ np.full(depth, -1, h.dtype)).reshape(m, n, HEADS)
        dc = dc.transpose(0, 2, 1, 3)
        da = dc @ v.transpose(0, 1, 3, 2)
        da *= a
        d = np.empty((m, n, 3, HEADS, depth), h.dtype)
        dq, dk, dv = (d[:, :, i].transpose(0, 2, 1, 3) for i in range(3))
        np.matmul(da, k, out=dq)
        np.matmul(da.transpose(0, 1, 3, 2), q, out=dk)
        np.matmul(a.transpose(0, 1, 3, 2), dc[..., :depth], out=dv)
        d = d.reshape(-1, 3 * WIDTH)
        for name, part in zip(("query", "key", "value"), np.split(e.T @ d, 3, axis=1)):
            out[name] = part * np.float32(depth**-0.5) if name == "query" else part
        de = d @ self._wide().T
        de += dh
        out = {name: (slice(len(g)), g) for name, g in (out | {"place": de.reshape(m, n, WIDTH).sum(0)}).items()}
        return out | {"first": _row_sums(de, x.ravel()), "last": _row_sums(de, z.ravel())}

    def train(self, batches: Iterator[tuple[np.ndarray, ...]], rate: float) -> None:
        """A step of Adam for each batch. A row that a batch has no slope for stays, and so do its means."""
        # Ten times the mean, and a hundred times the mean square: so slopes are added as they are.
        mean, square = ({n: np.zeros_like(v) for n, v in self.w.items()} for _ in range(2))
        for step, batch in enumerate(batches, 1):
            more = (1 - 0.99**step) ** -0.5
            now = rate * min(1.0, step / 30) / (1 - 0.9**step) / more
            for n, (rows, g) in self._slopes(*batch).items():
                m, s = mean[n][rows], square[n][rows]
                m *= np.float32(0.9)
                m += g
                g *= g
                s *= np.float32(0.99)
                s += g
                if not isinstance(rows, slice):
                    mean[n][rows], square[n][rows] = m, s
                d = np.sqrt(s, out=g)
                d += np.float32(1e-7 / more)
                np.divide(m, d, out=d)
                d *= np.float32(now)
                self.w[n][rows] -= d


AttentionModel.CELLS = AttentionModel.cells(CLASSES)


def windows(sizes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, places that an earlier window scored) of each window over parts of these sizes, which follow each other."""
    per = 1 + -(-np.maximum(sizes - WINDOW, 0) // stride)
    part = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(part)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.cumsum(sizes) - sizes
    length = np.minimum(WINDOW, sizes[part] - k * stride)
    return begin[part] + k * stride, length, np.where(k > 0, WINDOW - stride, 0)


def _batches(at: np.ndarray, length: np.ndarray, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of like length together: (numbers of the windows, their places, which of these are real)."""
    padded = -(-length // 16) * 16
    for n in np.unique(padded):
        own = np.flatnonzero(padded == n)
        for k in range(0, len(own), max(1, size // int(n))):
            some = own[k : k + max(1, size // int(n))]
            inside = np.arange(n) < length[some, None]
            yield some, np.where(inside, at[some, None] + np.arange(n), 0), inside


class _Block:
    """A block's texts as ranks of subword ids, and what comes before each."""

    def __init__(self, batch: pa.RecordBatch, k: int, known: Ranks) -> None:
        get = lambda n: batch.column(n)[k].as_py()
        self.number, self.rows = get("block"), np.array(get("rows"), np.int64)
        self.held, self.words = np.array(get("held"), bool), np.array(get("sizes"), np.int64)
        self.places = _unpacked(get("places"), "<u4")
        self.count, pieces, every = (_unpacked(get(c), kind) for c, kind in _WORD.items())
        every, head = every.astype(known.kind), np.cumsum(pieces, dtype=np.int64) - pieces
        self.begin_words = np.cumsum(self.words) - self.words
        self.sizes = np.add.reduceat(pieces[self.places], self.begin_words, dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        self.y, self.x = np.empty(total, known.kind), np.empty(total, known.kind)
        self.z, at = np.empty(total, np.uint8), 0
        depth = np.empty(total, np.uint8)
        for low in range(0, len(self.places), SLICE):
            some = self.places[low : low + SLICE]
            n = pieces[some].astype(np.int64)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            to = at + len(inside)
            self.y[at:to] = every[np.repeat(head[some], n) + inside]
            depth[at:to] = np.minimum(inside, LAST_CLASSES - 1)
            at = to
        self.x[1:], self.z[1:] = self.y[:-1], depth[:-1]
        self.x[self.begin], self.z[self.begin] = known.end, 0

    def train(self, model: AttentionModel, rate: float) -> int:
        """Steps over the training texts; their number of ids."""
        at, length, _ = windows(self.sizes, WINDOW)
        good = ~self.held[np.searchsorted(self.begin, at, side="right") - 1]
        at, length = at[good], length[good]
        rng = np.random.default_rng(self.number & 0xFFFFFFFF)
        mixed = rng.permutation(len(at))
        at, length = at[mixed], length[mixed]
        size = min(BATCH, max(LEAST_BATCH, int(length.sum()) // STEPS))
        model.train(self._mixed(at, length, size, rng), rate)
        return int(length.sum())

    def _mixed(self, at: np.ndarray, length: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, ...]]:
        """Batches of windows in any order, made one by one."""
        padded = -(-length // 16) * 16
        parts = []
        for n in np.unique(padded):
            own = np.flatnonzero(padded == n)
            parts += np.split(own, range(max(1, size // int(n)), len(own), max(1, size // int(n))))
        for k in rng.permutation(len(parts)):
            for _, p, real in _batches(at[parts[k]], length[parts[k]], size):
                yield self.x[p], self.z[p], self.y[p], real

    def scores(self, model: AttentionModel) -> np.ndarray:
        """ln P of each id."""
        out = np.full(len(self.y), np.nan, np.float32)
        at, length, known = windows(self.sizes, STRIDE)
        for some, p, real in _batches(at, length):
            new = real & (np.arange(p.shape[1]) >= known[some, None])
            out[p[new]] = model.log_shares(self.x[p], self.z[p], self.y[p], new)
        return out


_MEAN = "chunk int, value binary, weight double"


def _trainer(flat: np.ndarray, known: Ranks, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = AttentionModel.live(len(known.counts), known.trained)
        total, weight = np.zeros(len(live)), 0
        for batch in batches:
            for k in range(batch.num_rows):
                model = AttentionModel(flat, len(known.counts))
                n = _Block(batch, k, known).train(model, rate)
                total += n * model.flat()[live].astype(np.float64)
                weight += n
        if weight:
            parts = [(total[k : k + CELLS_A_ROW] / weight).astype("<f4").tobytes() for k in range(0, len(total), CELLS_A_ROW)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "value": pa.array(parts, pa.binary()), "weight": pa.array([float(weight)] * len(parts))})
        tidy()

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """The average of one chunk's weights."""
    n = rows.column("weight").to_numpy()
    total = sum(k * np.frombuffer(v.as_py(), "<f4").astype(np.float64) for k, v in zip(n, rows.column("value")))
    return pa.table({"chunk": rows.column("chunk")[:1], "value": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary()), "weight": pa.array([n.sum()])})


def train(blocks: DataFrame, known: Ranks) -> np.ndarray:
    """The weights after all rounds. Each round's blocks start from the same weights; the next starts from their average."""
    flat = AttentionModel.start(known.counts)
    live = AttentionModel.live(len(known.counts), known.trained)
    for k in range(ROUNDS):
        means = blocks.where(F.col("round") == k).mapInArrow(_trainer(flat, known, RATES[k]), _MEAN).groupBy("chunk").applyInArrow(_mean, _MEAN).toArrow()
        if means.num_rows:
            flat = flat.copy()
            flat[live] = np.frombuffer(b"".join(means.sort_by("chunk").column("value").to_pylist()), "<f4")
    return flat


# --- counted words ------------------------------------------------------------------------------

@dataclass
class Lexicon:
    """A counted model of words, spelled subword by subword, that no score uses any more: P(word | class) was part of the score before the attention model predicted
    every subword. Arrays by subword id; at most vocabulary x SPELL_CLASSES numbers."""

    vocabulary: int
    end: int
    counts: np.ndarray  # tokens that begin with the id
    kinds: np.ndarray  # different words that do
    first: np.ndarray  # class of a first subword
    last: np.ndarray  # class of a last subword
    before: np.ndarray  # class of a subword as the one before another
    steps: np.ndarray  # class before * (vocabulary + 1) + id after, ascending
    times: np.ndarray  # how many different words hold that step
    after: np.ndarray = field(init=False)  # log share of an id, or a word's end, among all steps
    totals: np.ndarray = field(init=False)
    prior: np.ndarray = field(init=False)  # log share of each class
    inside: np.ndarray = field(init=False)  # log share of a first subword in its class

    def __post_init__(self) -> None:
        s = self.vocabulary + 1
        n = np.bincount(self.steps % s, weights=self.times, minlength=s)
        self.after = np.log((n + 1) / (n.sum() + s))
        self.totals = np.bincount(self.steps // s, weights=self.times, minlength=SPELL_CLASSES)
        mass = np.bincount(self.first, weights=self.counts + LEAST, minlength=CLASSES)
        # A class that no id has never comes: its share is tiny, not zero.
        self.prior = np.log(np.maximum(mass, 1e-9) / np.maximum(mass, 1e-9).sum()).astype(np.float32)
        self.inside = np.log((self.counts + LEAST) / mass[self.first])

    def within(self, words: _Flat) -> np.ndarray:
        """log P(word | class of its first subword)."""
        owner, before, after = words.steps(self.vocabulary)
        cls = self.before[before]
        code = cls * (self.vocabulary + 1) + after
        at = np.minimum(np.searchsorted(self.steps, code), max(0, len(self.steps) - 1))
        seen = np.where(self.steps[at] == code, self.times[at], 0) if len(self.steps) else np.zeros(len(code))
        spelled = np.bincount(owner, weights=np.log((seen + SPREAD * np.exp(self.after[after])) / (self.totals[cls] + SPREAD)), minlength=len(words.sizes))
        n = self.counts[words.first]
        with np.errstate(divide="ignore"):
            known = np.log(np.maximum(words.count - DISCOUNT, 0)) - np.log(np.maximum(n, 1))
            left = np.where(n > 0, np.log(DISCOUNT * self.kinds[words.first]) - np.log(np.maximum(n, 1)), 0.0)
        return self.inside[words.first] + np.logaddexp(known, left + spelled)


# --- scoring ------------------------------------------------------------------------------------

_PART = "row long, held boolean, n_tokens long, n_known long, base double, score double"


def _scorer(flat: np.ndarray, known: Ranks, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = AttentionModel(flat, len(known.counts))
        for batch in batches:
            for k in range(batch.num_rows):
                b = _Block(batch, k, known)
                words = lambda x: np.add.reduceat(x[b.places], b.begin_words)  # noqa: B023, E731
                columns = (b.rows, b.held, b.words, words((b.count > 0).astype(np.int64)), words(np.log10((b.count + 1) / (n + 1 * (v + 1)))), np.add.reduceat(b.scores(model), b.begin, dtype=np.float64) / np.log(10))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "held", "n_tokens", "n_known", "base", "score"])
        tidy()

    return run


def _teller(known: Ranks):
    """Words to (word, count, ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("count"), known.packed(_Flat.of(batch))], names=["word", "count", "ranks"])

    return run


def _meet(key, blocks: pd.DataFrame, told: pd.DataFrame, kind: str) -> pd.DataFrame:
    """A block and what its words were told, in the order of the words' numbers."""
    b, t = blocks.iloc[0], told.sort_values("at")
    own = {"count": t["count"].to_numpy(), "pieces": t["ranks"].map(len).to_numpy() // np.dtype(kind).itemsize, "ranks": np.frombuffer(b"".join(t["ranks"]), kind)}
    values = (b["block"], b["rows"], b["held"], b["sizes"], b["places"], *(_packed(own[c].astype(as_)) for c, as_ in _WORD.items()), round_of(int(b["block"])))
    return pd.DataFrame({c.split()[0]: [v] for c, v in zip(_TOLD.split(", "), values)})


def _written(frame: DataFrame, tag: str, by: str | None = None) -> tuple[DataFrame, str]:
    path = scratch_path(frame.sparkSession, tag)
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def _discard(spark: SparkSession, path: str) -> None:
    """A scratch table that later tables stand for."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held_out_ids(doc_id: Column) -> Column:
    """The id as decimal text (null: empty) has a CRC-32 that leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, *, tokenizer: str, vocabulary: int = 50257, end: int = 50256, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model and all counts learn from the texts that aren't held out.

    Texts are whole; a null text is empty and holds the end alone, as does one of white space. Null and repeated ids are documents of their own; a null id's text is
    empty. Without training texts every count is 0 and the model gives what it starts from. An empty table gives no rows. tokenizer: the path of a byte-level
    tokenizer file on every executor, with vocabulary ids and end, one of them that no text gets.
    """
    spark = docs.sparkSession
    rows, unique = numbered(docs, id_col, text_col)
    cut = rows.select("row", held_out_ids(real_id()).alias("held"), "text").mapInArrow(_blocks(block), _BLOCKS)
    blocks, blocks_at = _written(cut, "lm-blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.train").alias("train"))
    words, words_at = _written(each.groupBy("word").agg(F.sum("train").alias("count")).mapInArrow(_encoder(tokenizer, end), "word binary, count long, ids binary"), "lm-words")
    size = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    known = ranks(words, vocabulary, end)
    kind = known.kind
    answers = words.mapInArrow(_teller(known), "word binary, count long, ranks binary")
    told = each.select(F.col("block").alias("own"), "at", "word").join(answers, "word").drop("word")
    met = blocks.drop("words", "train").groupBy("block").cogroup(told.groupBy("own")).applyInPandas(lambda key, b, t: _meet(key, b, t, kind), _TOLD)
    ready, ready_at = _written(met, "lm-told", "round")
    for path in (blocks_at, words_at):
        _discard(spark, path)
    flat = train(ready, known)
    parts = ready.mapInArrow(_scorer(flat, known, int(size.n), int(size.v)), _PART)
    sums = parts.groupBy("row").agg(F.first("held").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known")), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    out = sums.withColumn("doc_id", F.col("row")) if unique else sums.join(rows.select("row", "doc_id"), "row")
    return out.select(real_id().alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(size.n)).cast("long").alias("train_tokens"), "base_score", "score")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents. Null and empty texts are the end alone; an empty table gives no rows."""
    return score_texts(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
