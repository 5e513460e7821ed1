"""N-gram Jaccard join: exact classes of documents whose shingle sets are at least 0.8 alike. 1 - Jaccard is a metric; a link is at most 0.2 long.

1. Every document's distinct shingles go through the packed exchange, which tells each document which of its shingles other
   documents have, and how many have them (in powers of 2). A document of which fewer than 80 % are shared links with nothing.
2. Documents with equal sets (by a 128-bit digest) become one node. Linked nodes share one of their rarest n - ceil(0.8 n) + 1 shingles, so
   connecting nodes that do gives regions that no link leaves: unlike texts are all at distances of nearly 1, where pivots alone say nothing.
3. A region beyond CELL (nodes, each with its bytes as WEIGHT says) is split. Hash-random pivots get the distances of all its nodes, computed in chunks of CELL.
   Nodes within 0.2 of a pivot link with it. One of them whose distance plus 0.2 reaches no node outside this ball is done: it can't
   link with anything that isn't in the pivot's class already. The others form Voronoi cells: a node within CORE of its nearest
   pivot belongs to that pivot's cell, others to the cell of far nodes; and by the triangle inequality a node is replicated
   to each cell j whose own nodes it may link with: d_j <= CORE + 0.2 and d_j <= d_nearest + 0.4.
4. Cells are split in the same way again until they weigh at most CELL. A split is kept only if it pays: its cells weigh at most SPREAD times what they
   came from, and none that is still too big more than KEEP times. So rounds are at most log(region / CELL) / log(1 / KEEP), and a round's rows at
   most SPREAD times the last one's. What doesn't pay is cut into chunks of CELL / 2, each two of which meet in a task: a node has as many copies as there
   are other chunks. No task holds more than about CELL.
5. Small cells and regions are solved in memory, with pivots and triangle windows as above, else by comparing nodes that share a rare
   shingle. What cells find are star edges; their components are the classes.
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
from .components import connected_components
from .exchange import BLOCK, RANGES, bucket_edges, bucket_of, bundle, by_hash, gathered, pack, rows_of, unpack
from .tokens import chunks, job_seed, shingles

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Shingles in this many documents or more are of one class: the most frequent.
FREQUENT = 64
CHUNK = 1_000_000
_SENT = "bucket int, doc_id long, often boolean, blob binary"
#: A shingle and its frequency class; with the last three classes, the size of the set and the two halves of its digest.
_LISTED = np.dtype([("h", "<u8"), ("c", "u1")])
_SIZE, _LOW, _HIGH = 253, 254, 255
#: Nodes of a cell that one task solves, and bytes of shared shingles that weigh as much as a node.
CELL, NODE_BYTES = 4000, 4000
#: Pivots of a cell in a round, and how far from the nearest one a node of its cell is.
PIVOTS, CORE = 16, 0.5
#: What a split may weigh in all, and one of its cells that is still too big, in units of what was split.
SPREAD, KEEP = 1.5, 0.6
_LINK = 1 - NUMERATOR / DENOMINATOR
#: Covers the rounding of distances.
_EPS = 1e-9


def _sender(buckets: int, size: int, seed: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.uint64)
            d = np.concatenate([x[1] for x in held]) if held else np.zeros(0, np.int64)
            order, _ = by_hash(h, d)
            h, d = h[order], d[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
            h, d = h[once], d[once]
            n = np.bincount(d, minlength=len(ids))
            by_doc = np.argsort(d, kind="stable")  # hashes ascend within each document
            sets, ends = h[by_doc], np.cumsum(n)
            digests = [hashlib.blake2b(sets[e - k : e].tobytes(), digest_size=16).digest() for k, e in zip(n.tolist(), ends.tolist())]
            node = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            del by_doc, sets
            # Shingles of many documents of this block: the documents are told here, and the range gets one entry.
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[heads, len(h)])
            often = np.repeat(runs >= FREQUENT, runs)
            told: dict[int, np.ndarray] = {}
            if often.any():
                od, oh = d[often], h[often]
                o = np.argsort(od, kind="stable")
                od, oh = od[o], oh[o]
                cut = np.flatnonzero(np.r_[True, od[1:] != od[:-1]])
                told = {int(od[a]): part for a, part in zip(cut, np.split(oh, cut[1:]))}
            table_ = np.array(ids, np.int64)
            rows = [
                (b, i, None, _listed(np.array([n[k]]), _SIZE) + _listed(node[k, :1], _LOW) + _listed(node[k, 1:], _HIGH) + _listed(told.get(k, h[:0]), 6))
                for k, (i, b) in enumerate(zip(ids, bucket_of(table_, buckets).tolist()))
            ]
            sent, owner = h[~often], d[~often]
            edges = bucket_edges(sent, buckets)
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    used, local = np.unique(owner[part], return_inverse=True)
                    rows.append((b, None, False, pack(sent[part], local, table_[used], None)))
            many = h[heads[runs >= FREQUENT]]
            edges = bucket_edges(many, buckets)
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    rows.append((b, None, True, pack(many[edges[b] : edges[b + 1]], np.zeros(edges[b + 1] - edges[b], np.int64), np.zeros(0, np.int64), None)))
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "doc_id", "often", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = part.column(0).to_pylist()
                texts = [t.encode() for t in part.column(1).to_pylist()]
                for a, b in chunks(texts, CHUNK):
                    h, d = shingles(texts[a:b], size, seed)
                    held.append((h, d + len(ids)))
                    ids += own[a:b]
                    total += len(h)
                    if total >= BLOCK:
                        yield flush()
                        total = 0
        if ids:
            yield flush()
        tidy()

    return send


def _listed(hashes: np.ndarray, level: int | np.ndarray) -> bytes:
    out = np.empty(len(hashes), _LISTED)
    out["h"], out["c"] = hashes, level
    return out.tobytes()


def _teller(buckets: int):
    return lambda rows: bundle(*_tell(rows), buckets)


def _tell(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One range: to each document, its shingles that are shared, with their classes. Rows of documents pass."""
    docs, records = rows_of(rows[rows["doc_id"].notna()], _LISTED.itemsize)
    rest = rows[rows["doc_id"].isna()]
    flagged = rest["often"].astype(bool)
    hot = np.unique(np.concatenate([unpack(b)[0] for b in rest["blob"][flagged]])) if flagged.any() else np.zeros(0, np.uint64)
    if (~flagged).any():
        got = [unpack(b)[:2] for b in rest["blob"][~flagged]]
        h, d = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        del got
        order, heads = by_hash(h, d)
        h, d = h[order], d[order]
        # Most shingles are in one document only; they go before the rest is looked at.
        several = np.repeat(np.diff(np.r_[heads, len(h)]) > 1, np.diff(np.r_[heads, len(h)]))
        if len(hot):
            several |= np.isin(h, hot)
        h, d = h[several], d[several]
        once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
        h, d = h[once], d[once]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        runs = np.diff(np.r_[heads, len(h)])
        level = np.minimum(np.log2(runs).astype(np.int64), 6)
        level[np.isin(h[heads], hot)] = 6
        level = np.repeat(level, runs)
        shared = level > 0
        h, d, level = h[shared], d[shared], level[shared]
        docs, records = np.concatenate((docs, d)), np.concatenate((records, np.frombuffer(_listed(h, level), np.uint8).reshape(-1, _LISTED.itemsize)))
    return docs, records


def least(n: np.ndarray | int):
    """The least intersection of a set of n with a linked one: ceil(0.8 n)."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n, digest, shared shingles, rarest first); shared is null for documents of which too few are shared."""
    for batch in batches:
        out = []
        for i, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(told, _LISTED)
            n = int(got["h"][got["c"] == _SIZE][0])
            digest = got["h"][got["c"] == _LOW].tobytes() + got["h"][got["c"] == _HIGH].tobytes()
            got = np.unique(got[got["c"] < _SIZE])
            raw = None
            if n and len(got) >= least(n):
                raw = got["h"][np.lexsort((got["h"], got["c"]))].tobytes()
            out.append((i, n, digest, raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "n", "digest", "shared"])


def _prefix(n: int, raw: bytes) -> np.ndarray:
    """The shared ones among the set's rarest n - ceil(0.8 n) + 1 shingles; the ones of no other document are the rarest."""
    shared = np.frombuffer(raw, "<u8")
    return shared[: max(0, n - least(n) + 1 - (n - len(shared)))]


_HUBS = "shingle long, hub long, node long, nodes long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, rows (shingle, hub, null, nodes) for the rare shingles, the hub being the least of its nodes there, and edges (null, hub, node, null). So a
    shingle of very many nodes is one row per batch."""
    for batch in batches:
        found = [_prefix(n, raw) for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
        shingle = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        order = np.lexsort((node, shingle))
        node, shingle = node[order], shingle[order]
        heads = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]][: len(shingle)])
        sizes = np.diff(np.r_[heads, len(shingle)])
        hub = np.repeat(node[heads], sizes)
        edges = np.unique(np.stack((hub, node), 1)[node != hub], axis=0)
        some, none = lambda x: pa.array(x, pa.int64()), lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([some(shingle[heads]), some(node[heads]), none(len(heads)), some(sizes)], names=["shingle", "hub", "node", "nodes"])
        yield pa.RecordBatch.from_arrays([none(len(edges)), some(edges[:, 0]), some(edges[:, 1]), none(len(edges))], names=["shingle", "hub", "node", "nodes"])


class Region:
    """Nodes of one region in memory; finds their classes."""

    def __init__(self, sizes: np.ndarray, shared: list[np.ndarray]) -> None:
        self.n = np.asarray(sizes, np.int64)
        lengths = np.array([len(s) for s in shared])
        flat = np.concatenate(shared)
        tokens, ids = np.unique(flat, return_inverse=True)
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.flat = ids.astype(np.int32)
        self.mark = np.zeros(len(tokens), bool)
        self.parent = np.arange(len(self.n))
        self.cls = self.parent.copy()
        prefix = [np.arange(a, a + max(0, int(n - least(n) + 1 - (n - m)))) for a, n, m in zip(self.starts, self.n, lengths)]
        owner = np.repeat(np.arange(len(self.n)), [len(p) for p in prefix])
        self.prefix = [self.flat[p] for p in prefix]
        token = np.concatenate(self.prefix)
        order = np.argsort(token, kind="stable")
        self.posting, self.first = owner[order], np.r_[0, np.cumsum(np.bincount(token, minlength=len(tokens)))]

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return int(k)

    def common(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections."""
        mine = self.flat[self.starts[pivot] : self.starts[pivot + 1]]
        self.mark[mine] = True
        lengths = self.starts[others + 1] - self.starts[others]
        firsts = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[others] - firsts, lengths) + np.arange(int(lengths.sum()))
        out = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), firsts)
        self.mark[mine] = False
        return out

    def compare(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, linked), in blocks of bounded memory."""
        d, linked = np.ones(len(others)), np.zeros(len(others), bool)
        lengths = self.starts[others + 1] - self.starts[others]
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(2_000_000, int(lengths.sum()) + 2_000_000, 2_000_000))
        a = 0
        for b in np.unique(np.r_[cuts, len(others)]):
            if b > a:
                inter = self.common(pivot, others[a:b])
                union = self.n[pivot] + self.n[others[a:b]] - inter
                d[a:b] = 1 - inter / union
                linked[a:b] = DENOMINATOR * inter >= NUMERATOR * union
                a = b
        return d, linked

    def candidates(self, k: int) -> np.ndarray:
        lists = [self.posting[self.first[t] : self.first[t + 1]] for t in self.prefix[k]]
        if not lists:
            return np.zeros(0, np.int64)
        c = np.unique(np.concatenate(lists))
        c = c[(c != k) & (DENOMINATOR * np.minimum(self.n[c], self.n[k]) >= NUMERATOR * np.maximum(self.n[c], self.n[k]))]
        return c

    def classes(self) -> np.ndarray:
        """The class of each node, as one of its nodes. cls holds the class each node had when it was last set; parent joins classes."""
        m, done = len(self.n), np.zeros(len(self.n), bool)
        for k in range(m):
            if done[k]:
                continue
            c = self.candidates(k)
            if len(c):
                roots = np.array([self.find(x) for x in np.unique(self.cls[c])])
                now = roots[np.searchsorted(np.unique(self.cls[c]), self.cls[c])]
                c = c[now != self.find(k)]
            if not len(c):
                continue
            _, linked = self.compare(k, c)
            for x in c[linked]:
                a, b = self.find(k), self.find(int(x))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            self.cls[np.r_[k, c[linked]]] = self.find(k)
            if linked.sum() >= 32:
                self._pivot(k, done)
        return np.array([self.find(k) for k in range(m)])

    def _pivot(self, k: int, done: np.ndarray) -> None:
        """Distances of all nodes to a pivot: a linked node whose window holds no node of another class is done."""
        every = np.arange(len(self.n))
        d, linked = self.compare(k, every)
        root = self.find(k)
        outside = np.array([self.find(x) != root for x in every])
        nearest = d[outside].min() if outside.any() else np.inf
        inside = ~outside
        # A link is at most 0.2 long; 1e-9 covers rounding of the distances.
        done |= inside & (d + (1 - NUMERATOR / DENOMINATOR) + 1e-9 < nearest)


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    region = Region(rows["n"].to_numpy(), [np.frombuffer(r, "<u8") for r in rows["shared"]])
    nodes = rows["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "class": nodes[region.classes()]})


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk of a cell's nodes, and all the cell's pivots: each node's distances to them, by number of the pivot."""
    pivots = rows[rows["pivot"] >= 0].sort_values("pivot")
    nodes = rows[rows["pivot"] < 0]
    both = pd.concat([pivots, nodes])
    region = Region(both["n"].to_numpy(), [np.frombuffer(r, "<u8") for r in both["shared"]])
    others = np.arange(len(pivots), len(both))
    d, linked = (np.stack(x, 1) for x in zip(*(region.compare(k, others) for k in range(len(pivots)))))
    return pd.DataFrame({"cell": nodes["cell"], "chunk": nodes["chunk"], "node": nodes["node"], "w": nodes["w"], "pivots": [pivots["node"].to_numpy()] * len(nodes), "d": list(d), "linked": list(linked)})


_WEIGHT = f"1D + length(shared) / {float(NODE_BYTES)}D"


def _split(work: DataFrame, big: DataFrame, salt: int, cell: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """work: (cell, node, n, shared, w). big: (cell, chunks), its cells that are too big. Returns star edges (a, b), and the cells that
    replace them: members (cell, node, w, parent), and what the parents weighed (parent, was)."""
    members = work.join(big, "cell").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("chunks")))
    # Each pivot is the node with the least of one of PIVOTS hashes: partial minima, no sort of a cell.
    picked = work.select("cell", "node").join(big, "cell").groupBy("cell", "chunks").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(salt + 7 + k)).alias("h"), "node"))["node"].alias(f"p{k}") for k in range(PIVOTS)))
    picked = picked.select("cell", "chunks", F.posexplode(F.array_sort(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))))).alias("pivot", "node"))
    pivots = work.join(picked, ["cell", "node"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    both = members.withColumn("pivot", F.lit(-1)).unionByName(pivots).select("cell", "chunk", "pivot", "node", "n", "shared", "w")
    far = write_once(both.groupBy("cell", "chunk").applyInPandas(_distances, "cell long, chunk long, node long, w double, pivots array<long>, d array<double>, linked array<boolean>"), "jaccard-distances")
    edges = far.select(F.col("node").alias("a"), F.explode(F.filter(F.arrays_zip("pivots", "linked"), lambda x: x["linked"])["pivots"]).alias("b")).where("a <> b")
    # The least distance of a node outside each pivot's ball.
    outside = far.groupBy("cell").agg(F.array(*(F.min(F.when(~F.get("linked", F.lit(k)), F.get("d", F.lit(k)))) for k in range(PIVOTS))).alias("outside"), F.sum("w").alias("was"))
    spread = outside.join(big, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks", "was")
    seen = far.join(spread, ["cell", "chunk"])
    done = F.exists(F.arrays_zip("d", "linked", "outside"), lambda x: F.coalesce(x["linked"], F.lit(False)) & (x["outside"].isNull() | (x["d"] + _LINK + _EPS < x["outside"])))
    left = seen.where(~done).withColumn("nearest", F.array_min("d")).withColumn("home", F.array_position("d", F.col("nearest")) - 1)
    core = F.col("nearest") <= CORE
    near = F.filter(F.transform("d", lambda d, k: F.when((core & (k == F.col("home"))) | ((d <= CORE + _LINK + _EPS) & (d <= F.col("nearest") + 2 * _LINK + _EPS)), k)), lambda k: k.isNotNull())
    # The last number is the far cell.
    cells = F.when(core, near).otherwise(F.concat(near, F.array(F.lit(PIVOTS))))
    moved = left.select("node", "w", F.col("cell").alias("parent"), F.explode(cells).alias("k"))
    return edges, moved.select(F.xxhash64("parent", "k", F.lit(salt)).alias("cell"), "node", "w", "parent"), outside.select(F.col("cell").alias("parent"), "was")


def _in_pairs(work: DataFrame, stuck: DataFrame, cell: int) -> DataFrame:
    """Cells that distances don't split: chunks of half a cell, each two of which are one task."""
    parts = F.greatest(F.lit(2), F.ceil(F.col("size") * 2 / cell)).cast("long")
    rows = work.join(stuck.withColumn("parts", parts).drop("size"), "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own <> other")
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(pair.alias("cell"), "node", "n", "shared").groupBy("cell").applyInPandas(_solve, "node long, class long")


def _classes(members: DataFrame, sets: DataFrame, cell: int, trace: list[float] | None = None) -> DataFrame:
    """members: (cell, node), the regions. sets: (node, n, shared). (node, component): the classes. trace: gets what each round's cells weigh."""
    found: list[DataFrame] = []
    salt = 1
    sets = sets.withColumn("w", F.expr(_WEIGHT))
    while True:
        work = members.join(sets, "node").select("cell", "node", "n", "shared", "w")
        sizes = write_once(work.groupBy("cell").agg(F.sum("w").alias("size"), F.count("*").alias("nodes")), "jaccard-sizes")
        if trace is not None:
            trace.append(sizes.agg(F.sum("size")).first()[0] or 0.0)
        big = sizes.where((F.col("size") > cell) & (F.col("nodes") > 2)).select("cell", F.ceil(F.col("size") / cell).cast("long").alias("chunks"))
        more = not big.isEmpty()
        small = work.join(big.select("cell"), "cell", "left_anti") if more else work
        solved = small.drop("w").groupBy("cell").applyInPandas(_solve, "node long, class long")
        if not more and not found:  # no node is in two cells
            return solved.withColumnRenamed("class", "component")
        found.append(solved.select(F.col("node").alias("a"), F.col("class").alias("b")))
        if not more:
            break
        edges, moved, was = _split(work, big, salt, cell)
        found.append(edges)
        moved = write_once(moved, "jaccard-cells")
        now = moved.groupBy("cell", "parent").agg(F.sum("w").alias("size"))
        now = now.groupBy("parent").agg(F.sum("size").alias("all"), F.max("size").alias("most")).join(was, "parent")
        # Cells that are all small enough are the last ones, however much they overlap: at most PIVOTS + 1 copies of a node, once.
        lost = write_once(now.where((F.col("most") > cell) & ((F.col("most") > KEEP * F.col("was")) | (F.col("all") > SPREAD * F.col("was")))).select("parent"), "jaccard-lost")
        members = moved.select("cell", "node")
        if not lost.isEmpty():
            whole = write_once(moved.join(lost, "parent").select(F.col("parent").alias("cell"), "node", "w").distinct(), "jaccard-whole")
            stuck = whole.groupBy("cell").agg(F.sum("w").alias("size"))
            found.append(_in_pairs(whole.drop("w").join(sets, "node"), stuck, cell).select(F.col("node").alias("a"), F.col("class").alias("b")))
            members = moved.join(lost, "parent", "left_anti").select("cell", "node")
        salt += 1000
    out = found[0]
    for more_edges in found[1:]:
        out = out.unionByName(more_edges)
    return connected_components(out)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, cell: int = CELL, trace: list[float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id of its class).

    Texts are lower-cased (A-Z). A text with fewer words than a shingle is one shingle; without words (or null) it has none and is alone. Each row is a
    document of its own, also if its id is null or repeats; a null id sorts before all others. An empty table gives an empty result.
    cell: nodes that one task solves. trace: gets what the cells of each round of splitting weigh.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    rows, unique = numbered(docs, id_col, text_col)
    sent = rows.select("row", "text").mapInArrow(_sender(RANGES * buckets, words, job_seed()), _SENT)
    told = sent.groupBy("bucket").applyInPandas(_teller(buckets), "bucket int, blob binary")
    sets = write_once(gathered(told, _LISTED.itemsize, None).mapInArrow(_gather, "row long, n long, digest binary, shared binary"), "jaccard-sets")
    ids = sets.select("row", "n", "digest", F.col("row").alias("doc_id")) if unique else sets.select("row", "n", "digest").join(rows.select("row", "doc_id"), "row")
    # One node for each set, however many documents have it; its number is its least row.
    some = sets.where("shared is not null").select("row", "digest")
    nodes = write_once(some.groupBy("digest").agg(F.min("row").alias("node")), "jaccard-nodes")
    near = write_once(sets.select(F.col("row").alias("node"), "n", "shared").join(nodes.select("node"), "node"), "jaccard-near")
    # Nodes that share a rare shingle are connected to the smallest of them: first in their batch, then these hubs with each other.
    held = write_once(near.select("node", "n", "shared").mapInArrow(_prefixes, _HUBS), "jaccard-hubs")
    local = held.where("shingle is not null")
    hubs = write_once(local.groupBy("shingle").agg(F.min("hub").alias("first"), F.sum("nodes").alias("nodes")).where("nodes > 1").drop("nodes"), "jaccard-shingles")
    edges = local.select("shingle", "hub").join(hubs, "shingle").where("hub <> first").select(F.col("hub").alias("a"), F.col("first").alias("b"))
    edges = edges.unionByName(held.where("shingle is null").select(F.col("node").alias("a"), F.col("hub").alias("b"))).distinct()
    regions = connected_components(edges).select(F.col("component").alias("cell"), "node")
    classes = _classes(write_once(regions, "jaccard-regions"), near, cell, trace)
    # Per set, then per class, then back: both joins have plain tables on both sides, so Spark can split a hot key's partition.
    of_set = write_once(ids.groupBy("digest").agg(F.min("doc_id").alias("first")).join(nodes.select("digest"), "digest"), "jaccard-sets-first")
    linked = write_once(classes.join(nodes, "node").join(of_set, "digest").select("digest", F.col("component").alias("class"), "first"), "jaccard-linked")
    first = write_once(linked.groupBy("class").agg(F.min("first").alias("component_id")), "jaccard-first")
    by_set = write_once(of_set.join(linked.join(first, "class").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "first").alias("component_id")), "jaccard-classes")
    out = ids.join(by_set, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component_id").alias("component_id"), "row")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents, 5-word shingles, links from 0.8. Null and empty texts have no shingles and are alone; an empty
    table gives no rows."""
    return jaccard_join(table(spark, sf_dir, "documents")).drop("row")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least_id AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) r ON r.x = w.doc_id
"""
