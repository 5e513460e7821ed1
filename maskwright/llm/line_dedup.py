"""Incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index is a list of committed generations in a shared folder; a manifest, written last, commits one, and LineIndex(spark, path) goes on from the
last. A generation holds
* postings: a row per line key and document that it added or, negative, removed. The exact reference counts are their sums;
* totals: the state of each key that it touched, after it: the least document that holds the key, if any does. Totals are bucketed by key, as are the keys that
  are looked up in them, so a lookup joins bucket by bucket and history is never shuffled. Beyond LEVELS tables they are merged into one;
* filters: of each shard of keys a chain of cuckoo filters. One that is full stays as it is, and a larger one follows it; nothing is rebuilt.

An insertion probes its keys' shard filters: a miss proves that the key is new, and only hits are looked up in the totals. Misses and false hits are then
added, so each live key has a fingerprint of its own, in the filter of its chain that was open when it was added. Deletions append negative
postings and take the keys whose count fell to 0 out of that filter, so dedup is reversible: a document that is deleted gives its lines back to the next
smallest holder. Documents that a later generation changes are listed by affected(), and render() gives their lines as they are now.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, real_id, scratch_path, shuffle_partitions, table, tidy

SPACE = b" \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 10
SLOTS, MAX_KICKS, LOAD = 4, 400, 0.84
_LINES = "doc_id long, h1 long, h2 long, n long"
_KEPT = "doc_id long, text string, carried %s, n_lines long, n_dropped long, kept_sha256 string"


# --- keys ---------------------------------------------------------------------------------------

def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased. bytes.lower() leaves all but A-Z alone."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CODE_POINTS and (len(key) >= 4 * MIN_CODE_POINTS or len(key.decode("utf-8", "replace")) >= MIN_CODE_POINTS)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, counts = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: dict[bytes, int] = {}
            for line in text.encode().split(b"\n"):
                key = line_key(line)
                if long_enough(key):
                    h = key_hash(key)
                    own[h] = own.get(h, 0) + 1
            ids += [i] * len(own)
            digests += own.keys()
            counts += own.values()
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h1": both[:, 0].copy(), "h2": both[:, 1].copy(), "n": pa.array(counts, pa.int64())})


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for i, text, drops in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines, kept = text.split("\n"), None
            if drops:
                gone = set(np.array([(d["h1"], d["h2"]) for d in drops], "<i8").view("V16").ravel().tolist())
                kept = []
                for line in lines:
                    key = line_key(line.encode())
                    if not long_enough(key) or key_hash(key) not in gone:
                        kept.append(line)
            left = text if kept is None else "\n".join(kept)
            for column, value in zip(out, (i, left, len(lines), 0 if kept is None else len(lines) - len(kept), hashlib.sha256(left.encode()).hexdigest())):
                column.append(value)
        done = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*done[:2], batch.column(3), *done[2:]], names=["doc_id", "text", "carried", "n_lines", "n_dropped", "kept_sha256"])
    tidy()


# --- cuckoo filter ------------------------------------------------------------------------------

class CuckooFilter:
    """Buckets of 4 slots of 16-bit fingerprints, over arrays of 64-bit keys. It never misses a key that it holds;
    a key that it doesn't hold hits with a chance below 8 / 65535. Of a key inserted once, remove() takes out one copy."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        self.slots = np.zeros((self.n, SLOTS), np.uint16)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _finger(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._mix(np.asarray(keys, np.int64).view(np.uint64))
        return np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16), (h & np.uint64(self.n - 1)).astype(np.int64)

    def _other(self, b: np.ndarray, f: np.ndarray) -> np.ndarray:
        return b ^ (self._mix(f) & np.uint64(self.n - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, b = self._finger(keys)
        return (self.slots[b] == f[:, None]).any(1) | (self.slots[self._other(b, f)] == f[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if it is too full; then build a larger one from the exact table."""
        f, b = self._finger(keys)
        rng = np.random.default_rng(len(f))
        for _ in range(MAX_KICKS):
            for _ in range(2):
                if not len(f):
                    return True
                order = np.argsort(b, kind="stable")
                f, b = f[order], b[order]
                starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
                free = self.slots[b] == 0
                placed = rank < free.sum(1)
                slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
                self.slots[b[placed], slot[placed]] = f[placed]
                f, b = f[~placed], b[~placed]
                b = self._other(b, f)
            if len(f):  # one item of each full bucket changes places with a random resident
                order = np.argsort(b, kind="stable")
                f, b = f[order], b[order]
                head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                s = rng.integers(0, SLOTS, len(head))
                f[head], self.slots[b[head], s] = self.slots[b[head], s], f[head]
                empty = f == 0
                f, b = f[~empty], b[~empty]
                b = self._other(b, f)
        return not len(f)

    def remove(self, keys: np.ndarray) -> None:
        """Each key must have been inserted. All at once: the k-th key of a bucket and fingerprint takes the k-th slot that holds it."""
        f, b = self._finger(keys)
        for _ in range(2):
            if not len(f):
                return
            order = np.lexsort((f, b))
            f, b = f[order], b[order]
            starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (f[1:] != f[:-1])])
            rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
            held = self.slots[b] == f[:, None]
            here = rank < held.sum(1)
            slot = np.argmax(np.cumsum(held, 1) == (rank + 1)[:, None], 1)
            self.slots[b[here], slot[here]] = 0
            f, b = f[~here], b[~here]
            b = self._other(b, f)

    @classmethod
    def build(cls, keys: np.ndarray, least: int = 0) -> CuckooFilter:
        """With room for its keys, and for least."""
        size = max(64, least, len(keys))
        while True:
            out = cls(size)
            if out.insert(keys):
                return out
            size *= 2

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.n = len(raw) // (2 * SLOTS)
        out.slots = np.frombuffer(raw, np.uint16).reshape(out.n, SLOTS).copy()
        return out


# --- index --------------------------------------------------------------------------------------

#: Keys of a shard's filter, about, when an index begins.
SHARD_KEYS = 2_000_000
#: A shard's next filter has room for this many times its first keys, and for this many times the last filter's, so chains grow with the logarithm of the keys.
ROOM = 2
#: Tables of totals that a lookup joins at most.
LEVELS = 6
_KEYS = ["h1", "h2"]
_FILTERS = "shard int, since int, filter binary"
_TOTALS = "h1 long, h2 long, gen int, born int, first long"


def _name(at: str) -> str:
    """A folder's table name in the session."""
    return "mw_" + "".join(c if c.isalnum() else "_" for c in "_".join(at.rstrip("/").rsplit("/", 2)[1:]))


class LineIndex:
    """keys: (h1, h2), the 128-bit hash of the key. path: a shared folder; an index that it holds is opened. shards: their number is
    fixed for the life of an index. Unless given, there are as many as shuffle partitions, and more where the first batch has over
    SHARD_KEYS lines for each, so a shard's keys and filter stay in one task's memory."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None) -> None:
        self.spark = spark
        self.path = path or scratch_path(spark, "line-index")
        self.shards = shards
        self.generations: list[str] = []
        self.totals: list[str] = []
        self.filters: str | None = None
        committed = self._manifests()
        if committed:
            state = spark.read.json(f"{self.path}/manifest-{max(committed):06d}").first()
            self.shards, self.filters = int(state.shards), state.filters
            self.generations, self.totals = list(state.generations), list(state.totals)

    def _manifests(self) -> list[int]:
        """Numbers of the manifests that were written to the end."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return [int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found]

    def _commit(self) -> None:
        state = (self.shards, self.filters, self.generations, self.totals)
        rows = self.spark.createDataFrame([state], "shards int, filters string, generations array<string>, totals array<string>")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest-{len(self.generations):06d}")

    def _new(self, tag: str) -> str:
        """A folder of its own: one that an interrupted generation left behind is no obstacle."""
        return f"{self.path}/{tag}-{len(self.generations):06d}-{uuid.uuid4().hex[:8]}"

    def _shard(self):
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int").alias("shard")

    def postings(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The exact table: (doc_id, h1, h2, n), with n the signed number of the document's lines with that key; or just what the
        generations from first to before last added."""
        some = self.generations[first:last]
        return self.spark.read.schema(_LINES).parquet(*some) if some else self.spark.createDataFrame([], _LINES)

    @staticmethod
    def _live(postings: DataFrame) -> DataFrame:
        return postings.groupBy("h1", "h2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")

    def _held_filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(self.filters) if self.filters else self.spark.createDataFrame([], _FILTERS)

    def _bucketed(self, rows: DataFrame, tag: str) -> str:
        """Writes rows by key: a file per bucket, sorted, which joins with others of its kind need neither shuffle nor sort."""
        at = self._new(tag)
        rows.repartition(self.shards, *_KEYS).write.bucketBy(self.shards, *_KEYS).sortBy(*_KEYS).option("path", at).saveAsTable(_name(at))
        return at

    def _table(self, at: str, columns: str) -> DataFrame:
        """A bucketed table; a session that didn't write it is told of its buckets first."""
        if not self.spark.catalog.tableExists(_name(at)):
            self.spark.sql(f"CREATE TABLE {_name(at)} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.shards} BUCKETS LOCATION '{at}'")
        return self.spark.table(_name(at))

    def _states(self, keys: DataFrame) -> DataFrame:
        """keys: (h1, h2), distinct. (h1, h2, born, held): what the last totals that know a key say; held is null for one that no document holds any more."""
        wanted = self._table(self._bucketed(keys.select(*_KEYS), "wanted"), "h1 long, h2 long")
        found = [self._table(at, _TOTALS).join(wanted, _KEYS) for at in self.totals]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        last = every.groupBy("h1", "h2").agg(F.max(F.struct("gen", "born", "first")).alias("s"))
        return last.select("h1", "h2", F.col("s.born").alias("born"), F.col("s.first").alias("held"))

    def _keep(self, states: DataFrame) -> None:
        """states: as _TOTALS. Adds a table of totals; too many are merged into one."""
        self.totals.append(self._bucketed(states, "totals"))
        if len(self.totals) > LEVELS:
            every = self._table(self.totals[0], _TOTALS)
            for at in self.totals[1:]:
                every = every.unionByName(self._table(at, _TOTALS))
            last = every.groupBy("h1", "h2").agg(F.max(F.struct("gen", "born", "first")).alias("s")).select("h1", "h2", "s.gen", "s.born", "s.first")
            self.totals = [self._bucketed(last.where("first is not null"), "totals")]

    def _probe(self, fresh: DataFrame) -> DataFrame:
        """fresh: (h1, h2, first, last), a row per key. Returns it with seen: the key may be held already."""

        def per_shard(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            keys = new["h1"].to_numpy(np.int64)
            seen = np.zeros(len(keys), bool)
            for raw in old["filter"]:
                seen |= CuckooFilter.from_bytes(raw).contains(keys)
            return new[["h1", "h2", "first", "last"]].assign(seen=seen)

        new = fresh.withColumn("shard", self._shard()).groupBy("shard")
        probed = new.cogroup(self._held_filters().groupBy("shard")).applyInPandas(lambda key, a, b: per_shard(key, a, b), "h1 long, h2 long, first long, last long, seen boolean")
        probed.write.parquet(out := self._new("probe"))
        return self.spark.read.schema(probed.schema).parquet(out)

    def _add(self, keys: DataFrame, gen: int) -> None:
        """Adds keys (h1, h2) that no document holds to the filters: to the last of the shard's chain or, if that gets too full, to a new one."""

        def per_shard(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            add = new["h1"].to_numpy(np.int64)
            chain = [(int(r.since), r.filter) for r in old.sort_values("since").itertuples()]
            last = CuckooFilter.from_bytes(chain[-1][1]) if chain else None
            if last is not None and (not len(add) or last.insert(add)):
                chain[-1] = (chain[-1][0], last.to_bytes())
            else:
                chain.append((gen, CuckooFilter.build(add, ROOM * max(len(add), last.n * SLOTS if last else 0)).to_bytes()))
            return pd.DataFrame({"shard": key[0], "since": [c[0] for c in chain], "filter": [c[1] for c in chain]})

        new = keys.select("h1", "h2", self._shard()).groupBy("shard")
        made = new.cogroup(self._held_filters().groupBy("shard")).applyInPandas(lambda key, a, b: per_shard(key, a, b), _FILTERS)
        made.write.parquet(out := self._new("filters"))
        self.filters = out

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Adds the documents. Returns them as (doc_id, text, carried, n_lines, n_dropped, kept_sha256): a line whose key has
        at least 10 code points and is held by a document with a smaller id, of this batch or before, is gone from text.
        carried: a struct of the columns named in carry.

        Null ids are one document that sorts first; a null text is one empty line. Rows that repeat an id are one document, of one insertion or of several: what
        comes later adds to its lines. A batch without rows changes nothing. Hot keys meet only as partial counts; the join of postings with keys is one that Spark
        splits when it is skewed.
        """
        rows = keyed(docs, id_col, text_col, carry)
        rows.select("doc_id", "text").mapInArrow(_extract, _LINES).write.parquet(at := self._new("postings"))
        lines = self.spark.read.schema(_LINES).parquet(at)
        if self.shards is None:
            self.shards = max(shuffle_partitions(self.spark), -(-lines.count() // SHARD_KEYS))
        gen = len(self.generations)
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        probed = self._probe(fresh)
        state = probed.select("h1", "h2", F.lit(gen).alias("gen"), F.lit(gen).alias("born"), "first", "last")
        if self.totals:
            # A hit of a key that the totals don't hold was false: the key gets a fingerprint of its own.
            known = self._states(probed.where("seen"))
            both = probed.where("seen").join(known.where("held is not null"), _KEYS, "left")
            again = both.select("h1", "h2", F.lit(gen).alias("gen"), F.coalesce("born", F.lit(gen)).alias("born"), F.least("first", "held").alias("first"), "last")
            state = again.unionByName(probed.where("not seen").select("h1", "h2", F.lit(gen).alias("gen"), F.lit(gen).alias("born"), "first", "last"))
        state.write.parquet(state_at := self._new("state"))
        state = self.spark.read.schema(state.schema).parquet(state_at)
        self.generations.append(at)
        self._add(state.where(F.col("born") == gen).select(*_KEYS), gen)
        self._keep(state.drop("last"))
        self._commit()
        new = state.where("first < last").select("h1", "h2", "first")
        drops = lines.join(new, _KEYS).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
        return self._without(rows, drops)

    @staticmethod
    def _without(rows: DataFrame, drops: DataFrame) -> DataFrame:
        # The smaller side is built into hash tables, so the texts needn't be sorted.
        return rows.join(drops.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "drops", "carried").mapInArrow(_drop_lines, _KEPT % rows.schema["carried"].dataType.simpleString())

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents whose id is in the first column of ids; ids that the index doesn't hold change nothing. Their postings
        are cancelled; keys that no document holds any more leave the filters."""
        gone = ids.select(F.coalesce(ids[ids.columns[0]].cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        mine = self.postings().join(gone, "doc_id", "left_semi")
        self._live(mine).select("doc_id", "h1", "h2", (-F.col("n")).alias("n")).write.parquet(at := self._new("postings"))
        cancelled = self.spark.read.schema(_LINES).parquet(at).select("h1", "h2").distinct()
        gen = len(self.generations)
        self.generations.append(at)
        if self.totals:
            left = self._live(self.postings().join(cancelled, _KEYS, "left_semi")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
            state = self._states(cancelled).join(left, _KEYS, "left").select("h1", "h2", F.lit(gen).alias("gen"), "born", "first", F.col("held").isNotNull().alias("was"))
            state.write.parquet(state_at := self._new("state"))
            state = self.spark.read.schema(state.schema).parquet(state_at)
            dead = state.where("first is null and was").select("h1", "born", self._shard())

            def take_out(key, old: pd.DataFrame, dead: pd.DataFrame) -> pd.DataFrame:
                old = old.sort_values("since")
                # A key is in the filter that was the chain's last when it was added.
                place = np.searchsorted(old["since"].to_numpy(np.int64), dead["born"].to_numpy(np.int64), side="right") - 1
                out = []
                for k, raw in enumerate(old["filter"]):
                    if (place == k).any():
                        held = CuckooFilter.from_bytes(raw)
                        held.remove(dead["h1"].to_numpy(np.int64)[place == k])
                        raw = held.to_bytes()
                    out.append(raw)
                return pd.DataFrame({"shard": key[0], "since": old["since"].to_numpy(np.int64), "filter": out})

            old = self._held_filters().groupBy("shard")
            old.cogroup(dead.groupBy("shard")).applyInPandas(lambda key, a, b: take_out(key, a, b), _FILTERS).write.parquet(out := self._new("filters"))
            self.filters = out
            self._keep(state.drop("was"))
        self._commit()

    def reference_counts(self) -> DataFrame:
        """(h1, h2, documents, first): the exact table by key."""
        return self._live(self.postings()).groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))

    def affected(self, since: int) -> DataFrame:
        """(doc_id): documents of the first since generations, still held, of which later generations changed a line: one that was gone is
        back, or one that stayed is gone, as a smaller holder came or went."""
        touched = self.postings(since).select("h1", "h2").distinct()
        before, now = (self._live(p.join(touched, _KEYS, "left_semi")) for p in (self.postings(0, since), self.postings()))
        first = lambda x, name: x.groupBy("h1", "h2").agg(F.min("doc_id").alias(name))
        both = before.select("h1", "h2", "doc_id").join(now.select("h1", "h2", "doc_id"), ["h1", "h2", "doc_id"])
        changed = both.join(first(before, "was"), _KEYS).join(first(now, "is"), _KEYS).where("(doc_id > was) <> (doc_id > is)")
        return changed.select(real_id().alias("doc_id")).distinct()

    def render(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Documents that the index holds, as insert() returns them, by what it holds now. Nothing is added."""
        rows = keyed(docs, id_col, text_col, carry)
        lines = self._live(self.postings().join(rows.select("doc_id").distinct(), "doc_id", "left_semi"))
        first = self.reference_counts().select("h1", "h2", "first")
        drops = lines.join(first, _KEYS).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
        return self._without(rows, drops)


def dedup_lines(docs: DataFrame, *, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """insert() of a whole table into a new index, in batches of ascending ids: of the first, all keys are new; in later ones the filters
    tell which keys may be held, and the exact counts decide. A document's lines depend on smaller ids only, so each batch's answer holds.
    Null ids are in the first batch, and one document."""
    index = LineIndex(docs.sparkSession)
    own = F.col(f"`{id_col}`").cast("long")
    cuts = docs.select(F.percentile_approx(F.coalesce(own, F.lit(NULL_ID)), [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] or []
    out: DataFrame | None = None
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        # Plain comparisons, so that files and row groups of other ids are not read.
        some = docs if low is None else docs.where(own > low)
        if high is not None:
            some = some.where((own <= high) | own.isNull()) if low is None else some.where(own <= high)
        kept = index.insert(some, id_col=id_col, text_col=text_col, carry=carry)
        out = kept if out is None else out.unionByName(kept)
    return out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents; a null or empty text is one empty line. An empty table gives no rows."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(real_id().alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > shared.first, false) AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
