"""Suffix-array dedup: bytes of any 50-byte string that also starts in a document with a smaller id go.

Windows of 50 bytes are dealt to shards by their least 20-byte hash (their minimizer), so equal windows meet, and
neighbouring windows, which mostly share it, travel as one stretch of text. A first exchange of the minimizers alone keeps
at home what no other document can have. Each shard sorts the suffixes of its stretches by induced sorting; windows that
are equal follow each other there, and the common prefix of neighbours tells where they part. What a shard has beyond PASS bytes is
cut anew with longer seeds, up to whole windows, and sorted in passes, so a phrase that many documents share needn't fit one sort.

Hashes only bring together what may be equal: bytes go after a comparison of the bytes themselves.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, real_id, shuffle_partitions, table
from .exchange import CHUNK, bucket_of, bundle, by_hash, covered, from_spans, gathered, planes, repeated, rows_of, spans_of, split_by, unplanes
from .induced_sort import suffix_order
from .tokens import chunks, mix, powers, rolling, same_spans

LENGTH, SEED = 50, 20
#: Shards for each shuffle partition, and bytes of stretches that a map task packs at a time.
SHARDS, BLOCK = 4, 3_000_000
#: Bytes of stretches sorted at a time by a shard, and the seeds' lengths it tries, by the window's length.
PASS, FINER = 24_000_000, (0.72, 1.0)
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 2**64)


def cut_up(data: np.ndarray, lengths: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data: texts of these lengths, one after another. Per stretch of windows with one minimizer the first window, the number of windows, the minimizer, and the
    text's number."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none.astype(np.uint64), none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_B, n)[:n], out=sums[1:])
    h = sums[seed:] - sums[:-seed]
    h *= powers(_B_INV, n + 1)[: len(h)]
    h = mix(h)
    w, span = length - seed + 1, 1
    while 2 * span <= w:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    if span < w:
        h = np.minimum(h[: len(h) - (w - span)], h[w - span :])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(ends - length + 1, starts), 1)
    np.add.at(change, ends, -1)
    valid = np.cumsum(change[:-1])[: len(h)] == 0
    begin = valid.copy()
    begin[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
    if seed == length:
        begin = valid.copy()
    first = np.flatnonzero(begin)
    stop = np.r_[np.flatnonzero(begin | ~valid), len(h)]
    count = stop[np.searchsorted(stop, first, side="right")] - first
    # Least hashes are small numbers; mixed again, they are dealt evenly.
    return first, count, mix(h[first] + np.uint64(1)), np.searchsorted(starts, first, side="right") - 1


def stretches(texts: list[bytes], length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cut_up() of the texts, joined, with the joined bytes before the rest."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return (data, *cut_up(data, np.array([len(t) for t in texts], np.int64), length, seed))


def _minimizers(length: int):
    def extract(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, h, owner = stretches(texts, length)
        return h, np.bincount(owner, minlength=len(texts))

    return extract


def _join(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    skip = starts - (np.cumsum(sizes) - sizes)
    return data[np.repeat(skip, sizes) + np.arange(int(sizes.sum()))]


def _pack(rows: np.ndarray, ids: np.ndarray, at: np.ndarray, counts: np.ndarray, h: np.ndarray, text: np.ndarray) -> bytes:
    """ids are packed only where they aren't the rows."""
    apart = bool((rows != ids).any())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I?", len(ids), apart) + planes(rows.astype("<i8")) + (planes(ids.astype("<i8")) if apart else b"") + planes(at.astype("<u4")) + planes(counts.astype("<u4")) + planes(h.astype("<u4")) + text.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, apart = struct.unpack_from("<I?", raw)
    rows, at = unplanes(raw, 5, n, "<i8")
    ids, at = unplanes(raw, at, n, "<i8") if apart else (rows, at)
    starts, at = unplanes(raw, at, n, "<u4")
    counts, at = unplanes(raw, at, n, "<u4")
    h, at = unplanes(raw, at, n, "<u4")
    return rows, ids, starts.astype(np.int64), counts.astype(np.int64), h, np.frombuffer(raw, np.uint8, offset=at)


_SENT = "bucket int, doc_id long, blob binary"


def copies(text: np.ndarray, offset: np.ndarray, sizes: np.ndarray, ids: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches equal, byte for byte, the stretch of the smallest id among those with the same hash; and that one's number."""
    order, heads = by_hash(content, ids)
    rep = np.empty(len(ids), np.int64)
    rep[order] = np.repeat(order[heads], np.diff(np.r_[heads, len(ids)]))
    equal = sizes == sizes[rep]
    at = np.flatnonzero(equal)
    equal[at] = same_spans(text, offset[at], offset[rep[at]], sizes[at])
    return equal, rep


def _sender(length: int, buckets: int):
    """Rows (doc_id, text, spans, id), doc_id being the row: the stretches that spans lists, to the shard of their minimizer. Of equal stretches in a block only the
    smallest document's goes; the others are removed in any case, and are told so."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            own, ids, at, counts, h, content = (np.concatenate([x[k] for x in held]) for k in range(6))
            text = np.concatenate([x[6] for x in held])
            held.clear()
            sizes = counts + length - 1
            offset = np.cumsum(sizes) - sizes
            equal, rep = copies(text, offset, sizes, ids, content)
            later = equal & (ids > ids[rep])
            rows = _told(own[later], at[later], counts[later], buckets)
            go = np.flatnonzero(~later)
            shard = ((h[go] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for b, k in split_by(shard[order], go[order]):
                rows.append((b, None, _pack(own[k], ids[k], at[k], counts[k], h[k] & np.uint64(0xFFFFFFFF), _join(text, offset[k], sizes[k]))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "doc_id", "blob"])

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                all_rows, texts, spans, all_ids = part.column(0).to_pylist(), [t.encode() for t in part.column(1).to_pylist()], part.column(2).to_pylist(), part.column(3).to_pylist()
                for a, b in chunks(texts, CHUNK):
                    if not any(spans[a:b]):
                        continue
                    data, first, count, h, owner = stretches(texts[a:b], length)
                    per = np.bincount(owner, minlength=b - a)
                    base = np.cumsum(per) - per
                    wanted = np.zeros(len(first), bool)
                    for k in range(a, b):
                        if spans[k]:
                            f, s = from_spans(spans[k])
                            wanted[base[k - a] + np.repeat(f - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))] = True
                    first, count, h, owner = first[wanted], count[wanted], h[wanted], owner[wanted]
                    sizes = count + length - 1
                    lengths = np.array([len(t) for t in texts[a:b]])
                    begins = np.cumsum(lengths) - lengths
                    content = rolling(data.astype(np.uint64) + np.uint64(1), first, first + sizes)
                    held.append((np.array(all_rows[a:b], np.int64)[owner], np.array(all_ids[a:b], np.int64)[owner], first - begins[owner], count, h, content, _join(data, first, sizes)))
                    total += int(sizes.sum())
                    if total >= BLOCK:
                        yield flush()
                        total = 0
        if total:
            yield flush()

    return send


def _told(ids: np.ndarray, at: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Whole stretches that go, by document."""
    docs, spans = spans_of(ids, at, counts)
    parts = split_by(docs, spans)
    to = bucket_of(np.array([i for i, _ in parts], np.int64), buckets).tolist()
    return [(b, i, p.tobytes()) for b, (i, p) in zip(to, parts)]


def duplicate_windows(text: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, length: int, budget: int = 64_000_000) -> np.ndarray:
    """text: stretches one after another, at offsets, with counts windows each, of documents ids. Which windows (all, in order) also start in
    a stretch of a smaller document?"""
    m = len(offsets)
    sizes = counts + length - 1
    # Symbols: 0 the end, 1 behind each stretch, 2 and up the bytes.
    t = np.ones(len(text) + m + 1, np.uint16)
    place = np.ones(len(t), bool)
    place[np.cumsum(sizes + 1) - 1] = False
    place[-1] = False
    t[place] = text.astype(np.uint16) + np.uint16(2)
    t[-1] = 0
    order = suffix_order(t, length, budget)
    begin = offsets + np.arange(m)
    window = np.full(len(t), -1, np.int32)  # number of the window that starts here
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    window[starts] = np.arange(len(starts), dtype=np.int32)
    order = order[window[order] >= 0]
    raw = np.zeros(len(t) + 8, np.uint8)
    raw[: len(t)][place] = text
    eight = np.ndarray((len(t),), "<u8", raw, strides=(1,))
    a, b = order[1:], order[:-1]
    # The common prefix with the neighbour counts up to length.
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= eight[a + k] == eight[b + k]
    heads = np.flatnonzero(np.r_[True, ~same])
    owner = np.repeat(ids, counts)[window[order]]
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.r_[heads, len(order)]))
    out = np.zeros(len(starts), bool)
    out[window[order]] = owner > least
    return out


def later_windows(text: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, length: int, limit: int = PASS, finer: tuple[float, ...] = FINER) -> np.ndarray:
    """duplicate_windows() in passes of about limit bytes. Text beyond that is cut with longer seeds, and dealt to passes by their hash: windows that are equal
    meet in one. Seeds as long as the window bring together equal windows, of which the first counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, bool)
    if len(text) <= limit or not finer:
        return duplicate_windows(text, offsets, counts, ids, length)
    out = np.zeros(total, bool)
    seed = max(SEED, int(length * finer[0]))
    sizes = counts + length - 1
    window = np.cumsum(counts) - counts  # number of each stretch's first window
    parts: list[tuple] = []
    ends = np.cumsum(sizes)
    low = 0
    while low < len(counts):  # in blocks, as hashes take more memory than text
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit // 4, side="right")))
        block = _join(text, offsets[low:high], sizes[low:high])
        starts = np.cumsum(sizes[low:high]) - sizes[low:high]
        first, count, h, owner = cut_up(block, sizes[low:high], length, seed)
        parts.append((offsets[low + owner] + first - starts[owner], count, h, ids[low + owner], window[low + owner] + first - starts[owner]))
        low = high
    at, count, h, own, number = (np.concatenate([p[k] for p in parts]) for k in range(5))
    del parts
    passes = 1 + int((count + length - 1).sum()) // limit
    turn = (h % np.uint64(passes)).astype(np.int64)
    for k in range(passes):
        pick = np.flatnonzero(turn == k)
        own_sizes = count[pick] + length - 1
        if seed == length:  # single windows: those equal to the first of their hash need no sort
            same, rep = copies(text, at[pick], own_sizes, own[pick], h[pick])
            out[number[pick[same]]] = own[pick][same] > own[pick][rep[same]]
            pick, own_sizes = pick[~same], own_sizes[~same]
            if len(pick):
                part = _join(text, at[pick], own_sizes)
                out[number[pick]] = duplicate_windows(part, np.cumsum(own_sizes) - own_sizes, count[pick], own[pick], length)
            continue
        part = _join(text, at[pick], own_sizes)
        gone = later_windows(part, np.cumsum(own_sizes) - own_sizes, count[pick], own[pick], length, limit, finer[1:])
        out[np.repeat(number[pick] - (np.cumsum(count[pick]) - count[pick]), count[pick]) + np.arange(len(gone))] = gone
    return out


def _solver(length: int, buckets: int, limit: int = PASS):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        told = [rows_of(rows[rows["doc_id"].notna()], 8)]
        got = [_unpack(b) for b in rows["blob"][rows["doc_id"].isna()]]
        if got:
            own, ids, at, counts, h, text = (np.concatenate([g[k] for g in got]) for k in range(6))
            del got
            sizes = counts + length - 1
            offset = np.cumsum(sizes) - sizes
            # Copies of a stretch from different blocks: the smallest document's is sorted, the others go.
            content = rolling(text.astype(np.uint64) + np.uint64(1), offset, offset + sizes)
            equal, rep = copies(text, offset, sizes, ids, content)
            later = equal & (ids > ids[rep])
            told.append(spans_of(own[later], at[later], counts[later]))
            # Equal windows have equal minimizers: where all stretches of a minimizer are one text, nothing is left to find.
            left = np.flatnonzero(~later)
            order, heads = by_hash(h[left].astype(np.uint64), ids[left])
            runs = np.diff(np.r_[heads, len(order)])
            ordered = left[order]
            first = np.repeat(ordered[heads], runs)
            one = sizes[ordered] == sizes[first]
            k = np.flatnonzero(one)
            one[k] = same_spans(text, offset[ordered[k]], offset[first[k]], sizes[ordered[k]])
            several = ~np.logical_and.reduceat(one, heads) if len(heads) else np.zeros(0, bool)
            stay = np.sort(ordered[np.repeat(several, runs)])
            own, ids, at, counts, offset, sizes = (x[stay] for x in (own, ids, at, counts, offset, sizes))
            if len(stay):
                text = _join(text, offset, sizes)
                offset = np.cumsum(sizes) - sizes
                gone = np.flatnonzero(later_windows(text, offset, counts, ids, length, limit))
                k = np.repeat(np.arange(len(ids)), counts)[gone]
                told.append(spans_of(own[k], at[k] + gone - (np.cumsum(counts) - counts)[k], np.ones(len(k), np.int64)))
        return bundle(*(np.concatenate(x) for x in zip(*told)), buckets)

    return solve


_KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remover(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode()
                n, gone, runs = len(raw), 0, 0
                if spans:
                    cover = covered(n, spans, length)
                    gone, runs = int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                for column, value in zip(out, (i, raw, n, gone, runs, hashlib.sha256(raw).hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[f.split()[0] for f in _KEPT.split(", ")])

    return remove


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, kept (the bytes that stay; they may not be UTF-8), n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text goes if it is in a string of length bytes that also starts in a document with a smaller id.
    Repeats in one document stay. Null and empty texts, and shorter ones than length, keep all. Each row is a document of its own; of rows with equal ids, or null ones,
    none is the smaller, and a null id is smaller than all others. It comes back as the least long, for real_id(). An empty table gives an empty result. length: at least 24.

    Texts are shuffled once and meet both exchanges' answers there.
    """
    if length < SEED + 4:
        raise ValueError(f"length: at least {SEED + 4}")
    buckets = shuffle_partitions(docs.sparkSession)
    rows, _ = numbered(docs, id_col, text_col)
    rows = rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    near = repeated(rows.select("doc_id", "text"), _minimizers(length), buckets, apart=True)
    sent = rows.join(near.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "told", "id").mapInArrow(_sender(length, SHARDS * buckets), _SENT)
    gone = gathered(sent.groupBy("bucket").applyInPandas(_solver(length, buckets), "bucket int, blob binary"))
    return rows.join(gone.hint("shuffle_hash"), "doc_id", "left").select(F.col("id").alias("doc_id"), "text", "told").mapInArrow(_remover(length), _KEPT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents, strings of 50 bytes; null texts are empty. An empty table gives no rows."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept").withColumn("doc_id", real_id())


#: Texts go as hexadecimal digits, in pieces of 512 bytes and the 49 after them.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, h, n, unnest(range(0, (n + 511) // 512)) AS k FROM d),
q AS (SELECT doc_id, n, k, substr(h, 1024 * k + 1, 1122) AS piece FROM p),
b AS (SELECT doc_id, n, k, piece, unnest(range(0, least(512, n - 512 * k))) AS j FROM q),
w AS (SELECT doc_id, 512 * k + j AS i, CASE WHEN 512 * k + j + 50 <= n THEN substr(piece, 2 * j + 1, 100) END AS s, substr(piece, 2 * j + 1, 2) AS x FROM b),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
g AS (SELECT w.doc_id, w.i, w.x, coalesce(w.doc_id > f.first, false) AS hit FROM w LEFT JOIN f USING (s)),
c AS (SELECT doc_id, i, x, max(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM g),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
