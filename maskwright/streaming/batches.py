"""What runs once per micro-batch: a policy that may have changed, and an audit trail that a repeated batch doesn't repeat."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import Policy, PolicyFile
from ..sources import ledger as L


def policy_digest(policy: Policy) -> str:
    """One hash of all that a policy says."""
    return hashlib.sha256(json.dumps(asdict(policy), sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


class PolicyBatches:
    """For foreachBatch: reads the policy file again if it changed, applies apply(batch, policy), stamps each row with the policy's digest and its problem (null, if
    the file is good), and hands it to sink(rows, batch_id). A bad file keeps the last good policy. settle_ms: a file that changed less than that ago may still be
    being written, and counts from a later batch on."""

    def __init__(self, path: str, apply: Callable[[DataFrame, Policy], DataFrame], sink: Callable[[DataFrame, int], None], *, settle_ms: int = 0) -> None:
        self.file, self.apply, self.sink, self.settle_ms = PolicyFile(path), apply, sink, settle_ms

    def _settled(self) -> bool:
        try:
            return (time.time() - os.stat(self.file.path).st_mtime) * 1000 >= self.settle_ms
        except OSError:
            return True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self._settled():
            self.file.reload()
        out = self.apply(batch, self.file.policy).withColumn("policy_digest", F.lit(policy_digest(self.file.policy))).withColumn("policy_problem", F.lit(self.file.problem).cast("string"))
        self.sink(out, batch_id)


def _delete(spark: SparkSession, pattern: str) -> None:
    """Folders that match a pattern, if there are any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(at) or []:
        fs.delete(found.getPath(), True)


class AuditSink:
    """For foreachBatch: appends ledger entries to a folder by day, each batch's under its own name (of query and batch), so a batch that is tried again replaces what
    its first try left, and adds nothing. After each batch the folder is rotated, if most_bytes or keep is given.

    entries: the batch's rows as ledger entries (as L.entries() and its like make them). Any column beyond those of a ledger is an error: no raw value gets in.
    """

    COLUMNS = frozenset(["event_type", "timestamp", "category", "category_class", "count", "action", "detector_id", "rule", "confidence", "detection_stage", "span_length", "char_class_signature", "keyed_hash", "channel", "scan_field", "fail_reason", "reason"])

    def __init__(self, folder: str, entries: Callable[[DataFrame], DataFrame], *, name: str | None = None, most_bytes: int | None = None, keep: int | None = None) -> None:
        self.folder, self.entries, self.name, self.most_bytes, self.keep = folder, entries, name, most_bytes, keep

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = self.name or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("outside a streaming query, name the sink")
        rows = self.entries(batch)
        if odd := sorted(set(rows.columns) - self.COLUMNS):
            raise ValueError(f"not columns of a ledger: {odd}")
        tag = f"{name}-{batch_id}"
        _delete(spark, f"{self.folder}/day=*/batch={tag}")
        rows.withColumn("day", F.substring("timestamp", 1, 10)).withColumn("batch", F.lit(tag)).write.mode("append").partitionBy("day", "batch").json(self.folder)
        if self.most_bytes is not None or self.keep is not None:
            limits = {k: v for k, v in (("most_bytes", self.most_bytes), ("keep", self.keep)) if v is not None}
            L.rotate(spark, self.folder, **limits)
