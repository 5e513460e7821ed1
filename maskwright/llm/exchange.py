"""Packed exchange of hashed windows: which of them occur again elsewhere?

A map task sorts its hashes, packs them by hash range into compressed blobs (about 8 bytes a window
instead of the 30 to 40 of a row) and sends a blob per range. The task of a range sees all windows with these
hashes. Hashes that many documents of one block share are sent once per block, so a passage in
a third of all documents reaches a range as one entry per block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import tidy
from .tokens import chunks, mix

_ZIP = zstandard.ZstdCompressor(level=1)
#: Windows sorted and packed at a time by a map task.
BLOCK = 600_000
#: Hash ranges for each shuffle partition: one range is in memory at a time.
RANGES = 3
#: UTF-8 bytes hashed at a time.
CHUNK = 1_000_000
_SENT = "bucket int, doc_id long, known boolean, blob binary"
_TOLD = "bucket int, blob binary"


def planes(a: np.ndarray) -> bytes:
    """Byte k of all values, for each k: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(a.T).reshape(-1).view(kind), at + n * size


def pack(hashes: np.ndarray, ordinals: np.ndarray, ids: np.ndarray, starts: np.ndarray | None) -> bytes:
    """hashes: ascending. ordinals: of the window, or its document if starts is None. ids and starts: the block's documents."""
    delta = hashes.copy()
    delta[1:] -= hashes[:-1]
    parts = [struct.pack("<II?", len(hashes), len(ids), starts is not None), planes(delta), planes(ordinals.astype("<u4"))]
    if len(ids):
        parts.append(planes(np.diff(ids, prepend=0).astype("<i8")))
        if starts is not None:
            parts.append(planes(np.diff(starts, prepend=0).astype("<u4")))
    return _ZIP.compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document id, position in the document, or the plain ordinal)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, d, placed = struct.unpack_from("<II?", raw)
    delta, at = unplanes(raw, 9, n, "<u8")
    hashes = np.cumsum(delta, dtype=np.uint64)
    ordinals, at = unplanes(raw, at, n, "<u4")
    ordinals = ordinals.astype(np.int64)
    if not d:
        return hashes, np.zeros(n, np.int64), ordinals
    delta, at = unplanes(raw, at, d, "<i8")
    ids = np.cumsum(delta)
    if not placed:
        return hashes, ids[ordinals], ordinals
    delta, at = unplanes(raw, at, d, "<u4")
    starts = np.cumsum(delta.astype(np.int64))
    k = np.searchsorted(starts, ordinals, side="right") - 1
    return hashes, ids[k], ordinals - starts[k]


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ranges of ascending hashes begin: equal slices of the 64-bit space."""
    limits = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, limits), len(hashes)]


def by_hash(hashes: np.ndarray, *second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and, where hashes are equal, by the other keys; and where each run of equal hashes starts."""
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    if second and len(h):
        again = ~new
        again[:-1] |= ~new[1:]
        at = np.flatnonzero(again)
        part = order[at]
        order[at] = part[np.lexsort((*(k[part] for k in reversed(second)), h[at]))]
    return order, np.flatnonzero(new)


def to_spans(positions: np.ndarray) -> bytes:
    """Ascending positions, as (first, number) of each run of consecutive ones. Such bytes can be joined."""
    cut = np.flatnonzero(np.r_[True, positions[1:] != positions[:-1] + 1])
    return np.stack((positions[cut], np.diff(np.r_[cut, len(positions)])), 1).astype("<u4").tobytes()


def from_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def covered(n: int, spans: bytes | None, window: int) -> np.ndarray:
    """Which of n places a window that starts at one of the positions covers."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        first, size = from_spans(spans)
        np.add.at(change, np.minimum(first, n), 1)
        np.add.at(change, np.minimum(first + size - 1 + window, n), -1)
    return np.cumsum(change[:-1]) > 0


def split_by(keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """(key, values of that key) for ascending keys."""
    if not len(keys):
        return []
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(keys[cut].tolist(), *(np.split(v, cut[1:]) for v in values)))


def _several(order: np.ndarray, heads: np.ndarray, owner: np.ndarray, apart: bool) -> np.ndarray:
    """By run of equal hashes: are there several windows, or, if apart, several documents?"""
    if not len(order):
        return np.zeros(0, bool)
    if apart:
        own = owner[order]
        return np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
    return np.diff(np.r_[heads, len(order)]) > 1


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.asarray(ids, np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def rows_of(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (doc_id, blob of records) as (document of each record, records)."""
    sizes = [len(b) // width for b in rows["blob"]]
    return np.repeat(rows["doc_id"].to_numpy(np.int64), sizes), np.frombuffer(b"".join(rows["blob"]), np.uint8).reshape(-1, width)


def spans_of(docs: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as records of 8 bytes; those of a document that follow each other become one."""
    if not len(docs):
        return docs, np.zeros((0, 8), np.uint8)
    order = np.lexsort((firsts, docs))
    docs, firsts, counts = docs[order], firsts[order].astype(np.int64), counts[order].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (firsts[1:] != firsts[:-1] + counts[:-1])])
    both = np.stack((firsts[head], np.add.reduceat(counts, head)), 1).astype("<u4")
    return docs[head], both.view(np.uint8).reshape(-1, 8)


def merged(docs: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(records).view("<u4").reshape(-1, 2)
    return spans_of(docs, both[:, 0], both[:, 1])


def bundle(docs: np.ndarray, records: np.ndarray, buckets: int) -> pd.DataFrame:
    """Records for documents: one row per bucket of documents, however many documents there are."""
    bucket = bucket_of(docs, buckets)
    order = np.lexsort((docs, bucket))
    rows = []
    for b, k in split_by(bucket[order], order):
        own, cut = np.unique(docs[k], return_index=True)
        sizes = np.diff(np.r_[cut, len(k)]).astype("<u4")
        body = np.ascontiguousarray(records[k].T).tobytes()
        rows.append((b, _ZIP.compress(struct.pack("<I", len(own)) + planes(np.diff(own, prepend=0)) + planes(sizes) + body)))
    return pd.DataFrame(rows, columns=["bucket", "blob"]).astype({"bucket": "int32"})


def _unbundler(width: int, merge: Callable | None):
    def unbundle(rows: pd.DataFrame) -> pd.DataFrame:
        docs, records = [], []
        for blob in rows["blob"]:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            (n,) = struct.unpack_from("<I", raw)
            ids, at = unplanes(raw, 4, n, "<i8")
            sizes, at = unplanes(raw, at, n, "<u4")
            docs.append(np.repeat(np.cumsum(ids), sizes))
            records.append(np.frombuffer(raw, np.uint8, offset=at).reshape(width, -1).T)
        d, r = np.concatenate(docs), np.concatenate(records)
        if merge:
            d, r = merge(d, r)
        else:
            order = np.argsort(d, kind="stable")
            d, r = d[order], r[order]
        own, cut = np.unique(d, return_index=True)
        raw, ends = r.tobytes(), [*cut[1:].tolist(), len(d)]
        return pd.DataFrame({"doc_id": own, "told": [raw[a * width : b * width] for a, b in zip(cut.tolist(), ends)]})

    return unbundle


def gathered(told: DataFrame, width: int = 8, merge: Callable | None = merged) -> DataFrame:
    """Bundles to (doc_id, told), a row per document."""
    return told.groupBy("bucket").applyInPandas(_unbundler(width, merge), "doc_id long, told binary")


def _sender(extract: Callable, ranges: int, apart: bool):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(hashes)
            counts = np.concatenate(sizes)
            starts = np.cumsum(counts) - counts
            own = np.array(ids, np.int64)
            order, heads = by_hash(h)
            several = _several(order, heads, np.repeat(own, counts), apart)
            h = h[order]
            again = np.repeat(several, np.diff(np.r_[heads, len(h)]))
            rows = []
            if again.any():  # repeated in this block: told at once, and the range gets one entry
                at = np.sort(order[again])
                k = np.searchsorted(starts, at, side="right") - 1
                for doc, positions in split_by(k, at - starts[k]):
                    rows.append((int(bucket_of(own[doc : doc + 1], ranges)[0]), int(own[doc]), None, to_spans(positions)))
            for known, some, at in ((False, h[~again], order[~again]), (True, h[heads[several]], None)):
                edges = bucket_edges(some, ranges)
                for b in range(ranges):
                    a, e = edges[b], edges[b + 1]
                    if a == e:
                        continue
                    if known:
                        blob = pack(some[a:e], np.zeros(e - a, np.int64), own[:0], None)
                    else:
                        blob = pack(some[a:e], at[a:e], own, starts)
                    rows.append((b, None, known, blob))
            hashes.clear()
            ids.clear()
            sizes.clear()
            columns = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "doc_id", "known", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = part.column(0).to_pylist()
                texts = [t.encode() for t in part.column(1).to_pylist()]
                for a, b in chunks(texts, CHUNK):
                    h, counts = extract(texts[a:b])
                    if len(h):
                        some = np.flatnonzero(counts)
                        hashes.append(h)
                        ids += [own[a + k] for k in some]
                        sizes.append(counts[some])
                        total += len(h)
                    if total >= BLOCK:
                        yield flush()
                        total = 0
        if total:
            yield flush()
        tidy()

    return send


def _teller(apart: bool, buckets: int):
    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        """One range: the source coordinates of its windows that occur more than once."""
        docs, records = rows_of(rows[rows["doc_id"].notna()], 8)
        rest = rows[rows["doc_id"].isna()]
        known = rest["known"].astype(bool)
        flagged = np.concatenate([unpack(b)[0] for b in rest["blob"][known]]) if known.any() else np.zeros(0, np.uint64)
        got = [unpack(b) for b in rest["blob"][~known]]
        if got:
            h, d, p = (np.concatenate([g[k] for g in got]).astype(kind, copy=False) for k, kind in enumerate((np.uint64, np.int64, np.uint32)))
            del got
            order, heads = by_hash(h)
            several = _several(order, heads, d, apart)
            again = np.repeat(several | np.isin(h[order][heads], flagged), np.diff(np.r_[heads, len(h)]))
            at = order[again]
            own, found = spans_of(d[at], p[at], np.ones(len(at), np.int64))
            docs, records = np.concatenate((docs, own)), np.concatenate((records, found))
        return bundle(docs, records, buckets)

    return tell


def repeated(rows: DataFrame, extract: Callable, buckets: int, *, apart: bool = False) -> DataFrame:
    """rows: (doc_id, text). extract: texts to the hashes of their windows, in order, and the number of each text's. Returns (doc_id,
    told): the positions of windows whose hash occurs more than once or, if apart, in more than one document, for from_spans()."""
    sent = rows.mapInArrow(_sender(extract, RANGES * buckets, apart), _SENT)
    return gathered(sent.groupBy("bucket").applyInPandas(_teller(apart, buckets), _TOLD))
