"""Exact deduplication by content sort.

Splitters sampled from the data range-partition the normalised texts; an external sort inside each
partition places equal texts next to each other; a scan compares each text in full with its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, real_id, shuffle_partitions, table, write_once

_SCHEMA = "doc_id long, text_sha256 string, keep long, size long, head boolean, first boolean, edge boolean"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep", pa.int64()), ("size", pa.int64()),
     ("head", pa.bool_()), ("first", pa.bool_()), ("edge", pa.bool_())]
)


def _scan(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pick = max if largest else min

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[str, list[int]]] = []  # the runs of the current sort key: nearly always one
        key = first_key = None
        out: list[list] = [[] for _ in _ARROW]
        begun = False

        def close(last: bool) -> None:
            for text, ids in runs:
                sha, keep, before = hashlib.sha256(text.encode()).hexdigest(), pick(ids), None
                for k, i in enumerate(ids):
                    for column, value in zip(out, (i, sha, keep, len(ids), k == 0, i != before, last or key == first_key)):
                        column.append(value)
                    before = i

        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i, h, text in zip(cols["doc_id"].to_pylist(), cols["h"].to_pylist(), cols["text"].to_pylist()):
                if not begun:
                    begun, key, first_key = True, h, h
                if h != key:
                    close(False)
                    runs, key = [], h
                if runs and runs[-1][0] == text:
                    runs[-1][1].append(i)
                else:
                    runs.append((text, [i]))
            if len(out[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)
                out = [[] for _ in _ARROW]
        if begun:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    return scan


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null and empty texts are equal. Rows that repeat both id and text count in group_size, and one of them is
    kept. A null id sorts before all others. An empty table gives an empty result. Only the id and the text are read.

    Sort key: the first 16 characters, a hash of the whole text, the id. Splitters are thus short, whatever
    the texts' lengths, and a group of copies with a third of all rows is split over partitions by id. The text itself is
    the third sort key, so texts whose hash collides don't interleave. A run that touches the
    partition's first or last key is joined with its continuation by the digest: at most a few runs a partition, so
    that table may be broadcast (its bound is the number of partitions, not of rows).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    largest = keep == "largest"
    rows = keyed(docs, id_col, text_col)
    if normalise:
        rows = rows.select("doc_id", normalise(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "text", F.substring("text", 1, 16).alias("start"), F.xxhash64("text").alias("h"))
    n = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "start", "h", "doc_id").sortWithinPartitions("start", "h", "text", "doc_id")
    found = write_once(ordered.select("doc_id", "h", "text").mapInArrow(_scan(largest), _SCHEMA), "content-sort")
    best = F.max("keep") if largest else F.min("keep")
    edges = (
        found.where("edge and head").groupBy("text_sha256").agg(best.alias("edge_keep"), F.sum("size").alias("edge_size"))
        .withColumn("edge", F.lit(True))
    )
    whole = found.join(F.broadcast(edges), ["text_sha256", "edge"], "left")
    keep_id = F.coalesce("edge_keep", "keep")
    return whole.select(
        real_id().alias("doc_id"),
        F.when(keep_id != F.lit(-(2**63)), keep_id).alias("keep_id"),
        F.coalesce("edge_size", "size").alias("group_size"),
        (F.col("first") & (F.col("doc_id") == keep_id)).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents; null texts are empty. Of equal texts the largest id stays. An empty table gives no rows."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
