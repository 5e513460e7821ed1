"""Document fingerprints by locally consistent parsing.

Each level collapses runs of equal names, tosses deterministic coins (the lowest bit in which a name differs from its left neighbour, three
times, which leaves labels below 6), starts a phrase at each local minimum, and names phrases by their
contents. Where a phrase starts depends on a few names around it only, so equal substrings get the same phrases inside,
at any offset. The fingerprint is the bottom-k sketch of the set of phrase names of the last two levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, real_id, shuffle_partitions, table

LEVELS, KEEP = 3, 64
#: UTF-8 bytes parsed at once; a longer text is parsed alone.
CHUNK = 1_000_000
_R = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _coin(c: np.ndarray, head: np.ndarray) -> np.ndarray:
    """2 * (lowest differing bit) + that bit's value; at the head of a text, as if the neighbour were the complement's lowest bit."""
    left = np.empty_like(c)
    left[1:] = c[:-1]
    left[head] = ~c[head]
    x = c ^ left
    if c.dtype == np.uint64:
        low = (x & (~x + np.uint64(1))).astype(np.float64).view(np.int64)
        k = (low >> 52) - 1023  # exact: low is a power of 2
        return (2 * k + ((c >> k.astype(np.uint64)) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    return _COIN8[c.astype(np.int64) * 256 + x]


def _coin_table() -> np.ndarray:
    x = np.arange(256)
    low = np.zeros(256, np.int64)
    low[1:] = [(int(v) & -int(v)).bit_length() - 1 for v in x[1:]]
    return (2 * low[None, :] + ((x[:, None] >> low[None, :]) & 1)).astype(np.uint8).ravel()


_COIN8 = _coin_table()


def parse_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """names: of all texts, one after another; starts: where each (non-empty) text starts. Returns the next level's."""
    n = len(names)
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(names[1:], names[:-1], out=begin[1:])
    begin[starts] = True
    at = np.flatnonzero(begin)
    lengths = np.diff(at, append=n)
    one = names[at]
    if names.dtype == np.uint8:
        wide = _mix(one.astype(np.uint64) + np.uint64(1))
    else:
        wide = one.copy()
    many = lengths > 1
    wide[many] = _mix(wide[many] + _R * lengths[many].astype(np.uint64))
    heads = np.searchsorted(at, starts)
    # At the first level the labels are bytes; a run and a single of one byte never stand next to each other.
    c = _coin(one if names.dtype == np.uint8 else wide, heads)
    c = _coin(_coin(c, heads), heads)
    m = len(c)
    cut = np.zeros(m, bool)
    if m > 2:
        cut[1:-1] = (c[1:-1] < c[:-2]) & (c[1:-1] <= c[2:])
    last = np.append(heads[1:], m) - 1
    cut[last] = False  # the last name of a text ends a phrase
    cut[heads] = True
    firsts = np.flatnonzero(cut)
    sizes = np.diff(firsts, append=m)
    offset = np.arange(m) - np.repeat(firsts, sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    if len(powers) > 1:
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _R | np.uint64(1)))
    named = np.add.reduceat(_mix(wide) * powers[offset], firsts)
    return _mix(named + sizes.astype(np.uint64)), np.searchsorted(firsts, heads)


def phrases(texts: list[bytes], levels: int = LEVELS) -> list[np.ndarray]:
    """The last two levels' phrase names of each text."""
    full = [k for k, t in enumerate(texts) if t]
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not full:
        return out
    names = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0] + [len(texts[k]) for k in full[:-1]])
    upper: list[list[np.ndarray]] = []
    for level in range(levels):
        names, starts = parse_level(names, starts)
        if level >= levels - 2:
            upper.append(np.split(names, starts[1:]))
    for k, parts in zip(full, zip(*upper)):
        out[k] = np.concatenate(parts)
    return out


def sketches(texts: list[bytes], levels: int = LEVELS, keep: int = KEEP) -> list[np.ndarray]:
    """The keep smallest distinct names (their upper 32 bits) of each text, ascending."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        size, to = len(texts[k]), k + 1
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        for p in phrases(texts[k:to], levels):
            h = (p >> np.uint64(32)).astype(np.uint32)
            u = np.unique(np.partition(h, 4 * keep)[: 4 * keep]) if len(h) > 4 * keep else np.unique(h)
            # Repeated phrases may leave fewer than keep distinct ones among the smallest.
            out.append((u if len(u) >= keep or len(h) <= 4 * keep else np.unique(h))[:keep])
        k = to
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of the phrase sets, from the keep smallest of both; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = both[np.r_[True, ~twice]]
    if len(distinct) <= keep:
        return float(twice.sum() / len(distinct))
    return float((both[1:][twice] <= distinct[keep - 1]).sum() / keep)


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, turn, doc_id, text) in order; the last one of each range is the next range's first document."""
    held: tuple | None = None  # the row whose next isn't known yet: (range, doc_id, text, sketch)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ranges, ids, texts = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
            own = sketches([t.encode() for t in texts])
            rows = ([held] if held else []) + list(zip(ranges, ids, texts, own))
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
            held = rows[-1]
            if not pairs:
                continue
            edits = []
            for a, b in pairs:
                cut = len(a[2]) // 4
                edits.append((a[2][: len(a[2]) - cut] + b[2][:cut]).encode())
            edited = sketches(edits)
            columns = [
                pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array([fingerprint(a[3]) for a, _ in pairs]), pa.array([fingerprint(e) for e in edited]),
                pa.array([likeness(a[3], e) for (a, _), e in zip(pairs, edited)]), pa.array([likeness(a[3], b[3]) for a, b in pairs]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, fingerprint, and, for the text whose last quarter is replaced by the start of the next
    document (ascending id; after the last comes the first), edited_sha256, edited_fingerprint, near_edited, and near_next, the likeness to that next document.

    Null texts are empty; an empty text has the empty fingerprint, like only to another one. Rows that repeat an id follow each other in the order of their texts. A single
    document is its own next one. An empty table gives an empty result.

    Texts are shuffled once, to ranges of ids. Range borders come from the ids alone; the first document of each range
    also goes to the end of the range before it, so no range has to wait for another.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    n = shuffle_partitions(spark)
    ids = rows.select("doc_id")
    # One id per range reaches the driver: as many as there are partitions, however many rows there are.
    firsts = sorted(r[0] for r in ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id")).select(F.col("min(doc_id)")).collect())
    firsts = sorted(set(firsts))
    if not firsts:
        return spark.createDataFrame([], _OUT)
    sent = rows.mapInArrow(_placer(firsts), "range int, turn int, doc_id long, text string")
    ordered = sent.repartitionById(len(firsts), "range").sortWithinPartitions("range", "turn", "doc_id", "text")
    one_guard = ordered.mapInArrow(_one_guard, "range int, turn int, doc_id long, text string")
    return one_guard.mapInArrow(_run, _OUT).withColumn("doc_id", real_id())


def _placer(firsts: list[int]):
    """Each row to its range and, if it is the range's first document, as a guard to the end of the one before; the first range's to the last."""
    first = np.array(firsts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            own = np.searchsorted(first, ids, side="right") - 1
            guards = np.flatnonzero(first[own] == ids)
            rows = np.r_[np.arange(len(ids)), guards]
            to = np.r_[own, (own[guards] - 1) % len(first)].astype(np.int32)
            turn = np.r_[np.zeros(len(ids), np.int32), np.ones(len(guards), np.int32)]
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(turn), part.column(0), part.column(1)], names=["range", "turn", "doc_id", "text"])

    return place


def _one_guard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the guards of a range (rows that repeat an id), the first."""
    before = None
    for batch in batches:
        turns = np.asarray(batch.column(1))
        if turns.any():
            keys = list(zip(batch.column(0).to_pylist(), turns.tolist()))
            keep = []
            for k in keys:
                keep.append(not k[1] or k != before)
                before = k
            batch = batch.filter(pa.array(keep))
        if batch.num_rows:
            yield batch


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents; null texts are empty. An empty table gives no rows."""
    return fingerprints(table(spark, sf_dir, "documents"))
