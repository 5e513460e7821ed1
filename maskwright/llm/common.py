"""What every operator of this subpackage shares: reading tables, shared scratch tables, settings."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A null doc_id stands for one document that sorts before all others.
NULL_ID = -(2**63)


#: Rows that go to a Python worker at a time. Texts may be long, so the default of 10,000 would be much memory.
ROWS_PER_BATCH = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from any working folder.
    On a cluster it is installed or sent with --py-files as usual."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session; on a cluster its absence is an
    error, as each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = where.get() if where.isDefined() else None
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/maskwright-{tag}-{uuid.uuid4().hex}"


def write_once(frame: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: a lost executor costs nothing that came before it."""
    path = scratch_path(frame.sparkSession, tag)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Just (doc_id, text): null ids become NULL_ID, null texts the empty text; other columns can't clash. With carry also
    carried, a struct of the columns it names (at least of their number)."""
    more = [] if carry is None else [F.struct(F.lit(len(carry)).alias("columns"), *(F.col(f"`{c}`") for c in carry)).alias("carried")]
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *more,
    )


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> tuple[DataFrame, bool]:
    """keyed() with row, which tells rows apart, and whether ids are unique (null being one of them), as a count of the ids alone
    finds out. Then row is the id; else a number, written once so that it holds when tasks run again."""
    rows = keyed(docs, id_col, text_col, carry)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.withColumn("row", F.col("doc_id")), True
    return write_once(rows.withColumn("row", F.monotonically_increasing_id()), "rows"), False


def real_id(name: str = "doc_id"):
    """The id as it came: null again for NULL_ID."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def tidy() -> None:
    """At the end of a task: a Python worker that waits for the next job keeps no freed memory from the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
