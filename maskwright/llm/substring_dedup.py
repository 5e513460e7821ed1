"""Substring dedup on a de Bruijn graph of words.

Every 35 consecutive words are an edge, from their first to their last 34 words.

1. Minimizers (the least hash of 8 consecutive words in an edge) cut a document into stretches of edges, one entry for about 14 edges. The
   stretches whose minimizer occurs once can't hold a repeated edge, and stay at home.
2. The edges of the other stretches go to ranges of their hash. Occurrences of an edge are chained: each names its predecessor, a document
   and a place in it. However many there are, a document gets one claim and one answer for an edge, so no passage is a hot key.
3. A join by document brings the claims together. While an edge and the one it claims go on together, nothing branches between
   the two documents, so consecutive claims compact into one path: (place, length, document, place there).
4. A join by claimed document compares each path with the words at the source coordinates, by a cryptographic digest of both. What is equal
   is a repeat in both. A path that differs (hashes collided) is opened: its edges on both sides go through 2 to 4 again with another seed.
   Of the equal occurrences of an edge in a chain that has others, too, at least one is on the path of a claim that failed, so
   none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, real_id, shuffle_partitions, table, tidy, write_once
from .exchange import BLOCK, CHUNK, RANGES, bucket_edges, bucket_of, bundle, by_hash, covered, from_spans, gathered, pack, repeated, rows_of, spans_of, split_by, unpack
from .tokens import chunks, hash_windows, job_seed, mix, words

WINDOW = 35
_PLACE = np.uint64((1 << 24) - 1)
_SENT = "bucket int, row long, blob binary"
_TOLD = "bucket int, blob binary"
#: A path: its first edge, number of edges, the first edge claimed, the row claimed.
CLAIM = np.dtype([("first", "<u4"), ("count", "<u4"), ("there", "<u4"), ("other", "<i8")])
#: A path as the claimed row gets it: who asks, and the digest of the words there.
ASK = np.dtype([("other", "<i8"), ("first", "<u4"), ("count", "<u4"), ("there", "<u4"), ("digest", "V16")])


def edges_of(texts: list[bytes], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each edge, number of edges of each text)."""
    w, firsts = words(texts, seed)
    counts = np.maximum(np.diff(firsts) - window + 1, 0)
    start = np.arange(int(counts.sum())) + np.repeat(firsts[:-1] - (np.cumsum(counts) - counts), counts)
    return w, start, counts


def stretches(texts: list[bytes], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per stretch of edges with one minimizer: its hash, first edge (among all), number of edges, text. An edge that is repeated in one
    document has its minimizer at two places there, so in two stretches."""
    w, start, counts = edges_of(texts, window, seed)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    part = max(1, window // 4)
    s = hash_windows(w, part)
    # The place breaks ties, so the first of equal hashes counts; places repeat after 2**24 words.
    least = (s & ~_PLACE) | (np.arange(len(s), dtype=np.uint64) & _PLACE)
    many, span = window - part + 1, 1
    while 2 * span <= many:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < many:
        least = np.minimum(least[: len(least) - (many - span)], least[many - span :])
    own = least[start]
    place = ((start.astype(np.uint64) & ~_PLACE) | (own & _PLACE)).astype(np.int64)
    place[place < start] += 1 << 24
    owner = np.repeat(np.arange(len(texts)), counts)
    wraps = (start >> 24) != ((start + many) >> 24)
    head = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1]) | wraps[1:]])
    return mix(s[place[head]] + np.uint64(1)), head, np.diff(np.r_[head, len(own)]), owner[head]


def _minimizers(window: int, seed: int):
    def extract(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, _, _, owner = stretches(texts, window, seed)
        return h, np.bincount(owner, minlength=len(texts))

    return extract


def paths(rows: np.ndarray, at: np.ndarray, others: np.ndarray, there: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Claims of single edges, or of paths, compacted: (row, records of CLAIM), by row and place."""
    counts = np.ones(len(rows), np.int64) if counts is None else counts.astype(np.int64)
    at, there = at.astype(np.int64), there.astype(np.int64)
    order = np.lexsort((at, there - at, others, rows))
    rows, at, others, there, counts = (x[order] for x in (rows, at, others, there, counts))
    head = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (others[1:] != others[:-1]) | (there[1:] - at[1:] != there[:-1] - at[:-1]) | (at[1:] != at[:-1] + counts[:-1])][: len(rows)])
    out = np.empty(len(head), CLAIM)
    out["first"], out["there"], out["other"] = at[head], there[head], others[head]
    out["count"] = np.add.reduceat(counts, head) if len(head) else 0
    return rows[head], out.view(np.uint8).reshape(-1, CLAIM.itemsize)


def _merged(rows: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.ascontiguousarray(records).reshape(-1).view(CLAIM)
    own, out = paths(rows, c["first"], c["other"], c["there"], c["count"])
    return own, out


def _edge_sender(window: int, ranges: int, seed: int, cut: int | None, weak: int):
    """Rows (row, text, told): the edges of the stretches that told lists (cut: the seed they were cut with), or, without cut, the edges it
    lists. weak: bits of the hashes that are thrown away, for tests."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            h, at = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            own = np.array([x[2] for x in held], np.int64)
            sizes = np.array([len(x[0]) for x in held])
            held.clear()
            k = np.repeat(np.arange(len(own)), sizes)
            order, heads = by_hash(h, np.arange(len(h)))
            root = np.zeros(len(h), bool)
            root[heads] = True
            later = np.flatnonzero(~root)
            child, parent = order[later], order[later - 1]
            claimers, records = paths(own[k[child]], at[child], own[k[parent]], at[parent])
            rows = [(int(bucket_of(np.array([i]), ranges)[0]), int(i), r.tobytes()) for i, r in split_by(claimers, records)]
            first = order[heads]
            some = h[first]
            lengths = np.zeros(len(own), np.int64)
            np.maximum.at(lengths, k, at + 1)
            starts = np.cumsum(lengths) - lengths
            ordinal = starts[k] + at
            edges = bucket_edges(some, ranges)
            for b in range(ranges):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    rows.append((b, None, pack(some[part], ordinal[first[part]], own, starts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "row", "blob"])

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids, told = part.column(0).to_pylist(), part.column(2).to_pylist()
                texts = [t.encode() for t in part.column(1).to_pylist()]
                for a, b in chunks(texts, CHUNK):
                    w, start, counts = edges_of(texts[a:b], window, seed)
                    every = hash_windows(w, window)[start] if len(start) else np.zeros(0, np.uint64)
                    if weak:
                        every = mix(every >> np.uint64(weak))
                    base = np.cumsum(counts) - counts
                    if cut is not None:
                        _, heads, sizes, owner = stretches(texts[a:b], window, cut)
                        per = np.bincount(owner, minlength=b - a)
                        of = np.cumsum(per) - per
                    for k in range(a, b):
                        first, size = from_spans(told[k])
                        picks = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                        if cut is not None:
                            picks = picks + of[k - a]
                            f, n = heads[picks], sizes[picks]
                            picks = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) - base[k - a]
                        else:
                            picks = np.unique(picks)
                        held.append((every[base[k - a] + picks], picks, ids[k]))
                        total += len(picks)
                    if total >= BLOCK:
                        yield flush()
                        total = 0
        if total:
            yield flush()
        tidy()

    return send


def _chainer(buckets: int):
    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """One range: each occurrence of an edge but the first claims the one before."""
        docs, records = rows_of(rows[rows["row"].notna()].rename(columns={"row": "doc_id"}), CLAIM.itemsize)
        got = [unpack(b) for b in rows["blob"][rows["row"].isna()]]
        if got:
            h, d, p = (np.concatenate([g[k] for g in got]).astype(kind, copy=False) for k, kind in enumerate((np.uint64, np.int64, np.uint32)))
            del got
            order, heads = by_hash(h, d, p)
            root = np.zeros(len(h), bool)
            root[heads] = True
            later = np.flatnonzero(~root)
            child, parent = order[later], order[later - 1]
            own, found = paths(d[child], p[child], d[parent], p[parent])
            docs, records = np.concatenate((docs, own)), np.concatenate((records, found))
        return bundle(docs, records, buckets)

    return chain


def _digest(own: list[bytes], first: int, count: int, window: int) -> bytes:
    return hashlib.blake2b(b" ".join(own[first : first + count + window - 1]), digest_size=16).digest()


def _asker(window: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: list[np.ndarray] = []
        asks: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = bundle(np.concatenate(to), np.concatenate(asks).view(np.uint8).reshape(-1, ASK.itemsize), buckets)
            to.clear()
            asks.clear()
            return pa.RecordBatch.from_pandas(out, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]), preserve_index=False)

        for batch in batches:
            for i, text, told in zip(*(batch.column(k).to_pylist() for k in range(3))):
                c = np.frombuffer(told, CLAIM)
                own = text.encode().split()
                out = np.empty(len(c), ASK)
                out["other"], out["first"], out["count"], out["there"] = i, c["first"], c["count"], c["there"]
                out["digest"] = np.frombuffer(b"".join(_digest(own, f, n, window) for f, n in zip(c["first"].tolist(), c["count"].tolist())), "V16")
                to.append(c["other"])
                asks.append(out)
            if sum(map(len, asks)) >= BLOCK // 4:
                yield flush()
        if asks:
            yield flush()

    return ask


def _answerer(window: int, buckets: int):
    """Compares; emits the places of the edges that are repeated, and of those that stay open, by document."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[tuple]] = {False: [], True: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for open_, parts in found.items():
                if parts:
                    rows, firsts, counts = (np.concatenate([np.atleast_1d(p[k]) for p in parts]) for k in range(3))
                    told = bundle(*spans_of(*_joined(rows, firsts, counts)), buckets)
                    parts.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(told["bucket"], pa.int32()), pa.array([open_] * len(told)), pa.array(told["blob"], pa.binary())], names=["bucket", "open", "blob"])

        for batch in batches:
            for i, text, told in zip(*(batch.column(k).to_pylist() for k in range(3))):
                c = np.frombuffer(told, ASK)
                own = text.encode().split()
                same = np.array([_digest(own, f, n, window) == bytes(d) for f, n, d in zip(c["there"].tolist(), c["count"].tolist(), c["digest"])], bool)
                for open_ in (False, True):
                    x = c[same != open_]
                    if len(x):
                        found[open_].append((np.r_[x["other"], np.full(len(x), i)], np.r_[x["first"], x["there"]], np.r_[x["count"], x["count"]]))
            if sum(len(p[0]) for parts in found.values() for p in parts) >= BLOCK // 4:
                yield from flush()
        yield from flush()

    return answer


def _joined(rows: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    order = np.lexsort((firsts, rows))
    rows, firsts, ends = rows[order], firsts[order].astype(np.int64), firsts[order].astype(np.int64) + counts[order]
    if not len(rows):
        return rows, firsts, ends
    # The furthest end so far, apart for each row: rows get slices of a common axis.
    row_no = np.cumsum(np.r_[0, rows[1:] != rows[:-1]])
    width = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + row_no * width)
    head = np.flatnonzero(np.r_[True, (firsts + row_no * width)[1:] > reach[:-1]])
    last = np.r_[head[1:], len(rows)] - 1
    return rows[head], firsts[head], reach[last] - row_no[last] * width - firsts[head]


def _merge_spans(rows: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(records).view("<u4").reshape(-1, 2)
    return spans_of(*_joined(rows, both[:, 0], both[:, 1]))


_KEPT = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = text.encode().split()
                n, gone = len(own), 0
                if spans:
                    cover = covered(n, spans, window)
                    gone = int(cover.sum())
                    own = [w for w, c in zip(own, cover.tolist()) if not c]
                kept = b" ".join(own)
                for column, value in zip(out, (i, kept.decode(), n, gone, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return remove


def _settled(rows: DataFrame, told: DataFrame, window: int, seed: int, cut: int | None, weak: int) -> DataFrame:
    """told: (doc_id, told), doc_id being a row. (bucket, open, blob): edges that are repeated, and edges whose claims failed."""
    buckets = shuffle_partitions(rows.sparkSession)
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    meet = lambda what: texts.join(what.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "told")
    sent = meet(told).mapInArrow(_edge_sender(window, RANGES * buckets, seed, cut, weak), _SENT)
    claims = gathered(sent.groupBy("bucket").applyInPandas(_chainer(buckets), _TOLD), CLAIM.itemsize, _merged)
    asks = gathered(meet(claims).mapInArrow(_asker(window, buckets), _TOLD), ASK.itemsize, None)
    return meet(asks).mapInArrow(_answerer(window, buckets), "bucket int, open boolean, blob binary")


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", weak: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, text (the words that stay, joined by a space), n_words, n_removed, kept_sha256.

    A word goes if it is in a window of consecutive words of its row whose words also start anywhere else, in the same
    row too; of a repeat, no copy stays. Null and empty texts, and those with fewer words than a window, keep all words. Each row is a document
    of its own, also if its id is null or repeats; a null id comes back as the least long, for real_id(). An empty table gives an empty
    result.

    Hashes only bring together what may be equal; words go on account of an equal digest (BLAKE2b, 128 bits) of the words at both places. Texts
    are shuffled twice: to meet the exchanges, and to lose their words.
    """
    rows, _ = numbered(docs, id_col, text_col)
    buckets = shuffle_partitions(docs.sparkSession)
    cut = job_seed()
    told, done = repeated(rows.select(F.col("row").alias("doc_id"), "text"), _minimizers(window, cut), buckets), []
    while True:
        done.append(write_once(_settled(rows, told, window, job_seed(), cut, weak), "repeats"))
        failed = done[-1].where("open").select("bucket", "blob")
        if failed.isEmpty():
            break
        told, cut, weak = gathered(failed, 8, _merge_spans), None, max(0, weak - 8)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    spans = gathered(found.where("not open").select("bucket", "blob"), 8, _merge_spans).select(F.col("doc_id").alias("row"), "told")
    return rows.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "told").mapInArrow(_remover(window), _KEPT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents, windows of 35 words; null texts have no words. An empty table gives no rows."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("text").withColumn("doc_id", real_id())


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM pos),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN rep USING (h)),
word AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM w),
judged AS (SELECT word.doc_id, word.t, word.k, hit.k IS NOT NULL AS gone FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.k = hit.k),
done AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(t, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done USING (doc_id)
"""
