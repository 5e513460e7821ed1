"""Audit entries of detections, which never hold raw values; retention; file sources."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_class_signature, keyed_hash
from ..operators.evaluate import distinct_items


def entries(found: DataFrame, key: bytes, *, channel: str | None = None, scan_field: str | None = None) -> DataFrame:
    """found: ts, d (a detection). Entries of type block or mask."""
    d = lambda n: F.col(f"d.{n}")
    return found.select(
        F.when(d("action") == "block", "block").otherwise("mask").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        d("category"), d("category_class"), F.lit(1).alias("count"), d("action"), d("rule_id").alias("detector_id"), d("rule_id").alias("rule"), d("confidence"), d("detection_stage"),
        (d("end") - d("start")).alias("span_length"), char_class_signature(d("original")).alias("char_class_signature"), keyed_hash(d("original"), key).alias("keyed_hash"),
        F.lit(channel).cast("string").alias("channel"), F.lit(scan_field).cast("string").alias("scan_field"),
    )


def failure_entries(failures: DataFrame, *, channel: str | None = None) -> DataFrame:
    """failures: ts, stage, reason. Entries of type fail: what failed and why, never a text."""
    return failures.select(
        F.lit("fail").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(1).alias("count"), F.col("stage").alias("detection_stage"), F.col("reason").alias("fail_reason"), F.lit(channel).cast("string").alias("channel"),
    )


def gap_entries(gaps: DataFrame, *, channel: str | None = None) -> DataFrame:
    """gaps: ts, scan_field, reason, action. Entries of type coverage_gap: a field that wasn't scanned, and what was done."""
    return gaps.select(
        F.lit("coverage_gap").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(1).alias("count"), "action", "reason", "scan_field", F.lit(channel).cast("string").alias("channel"),
    )


def append(rows: DataFrame, folder: str) -> None:
    """By day, so retention drops whole folders."""
    rows.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(folder)


def retained(rows: DataFrame, now: Column, days: int) -> DataFrame:
    return rows.where(F.to_timestamp("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def rotate(spark: SparkSession, folder: str, *, most_bytes: int = 10 * 2**20, keep: int = 7) -> list[str]:
    """Days of a ledger folder beyond keep, oldest first, of those that came before the newest most_bytes: they are deleted, and returned. The newest
    day always stays."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted((str(f.getPath().getName()), fs.getContentSummary(f.getPath()).getLength()) for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("day=")) if fs.exists(root) else []
    held, gone = 0, []
    for k, (name, size) in enumerate(reversed(days)):
        held += size
        if k and (k >= keep or held > most_bytes):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
            gone.append(name.removeprefix("day="))
    return sorted(gone)


def purge(spark: SparkSession, folder: str, before: str) -> list[str]:
    """Deletes the days (YYYY-MM-DD) before the one given; returns them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(f.getPath().getName().removeprefix("day=") for f in fs.listStatus(root) if f.getPath().getName().startswith("day=")) if fs.exists(root) else []
    gone = [d for d in days if d < before]
    for d in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/day={d}"), True)
    return gone


_ITEMS = "array<struct<category:string,value:string>>"


def _items(case: Column, line: str) -> Column:
    """`CATEGORY` = value pairs of the first list line that holds the word (a pattern)."""
    held = F.regexp_extract(case, rf"(?m)^\s*-(?=[^\n]*(?:{line}))[^:\n]*:([^\n]*)$", 1)
    both = F.regexp_extract_all(held, F.lit(r"`(\w+)`\s*=\s*(.*?)(?=(?:,\s*`\w+`\s*=)|$)"), F.lit(0))
    each = F.transform(both, lambda m: F.struct(F.regexp_extract(m, r"`(\w+)`", 1).alias("category"), F.regexp_replace(F.trim(F.regexp_extract(m, r"(?s)=(.*)$", 1)), r",$", "").alias("value")))
    return F.filter(each, lambda x: (x["value"] != "") & (x["value"] != "—")).cast(_ITEMS)


def reports(texts: DataFrame) -> DataFrame:
    """texts: value, a markdown report. A row per case: seq, case_id, title, text (fenced or quoted), truth (the planted items, or else those detected and missed, each
    once). Cases without text or truth are left out."""
    cases = F.regexp_extract_all("value", F.lit(r"(?ms)^### \[(\d+)\][^\n]*\n(.*?)(?=^### |\z)"), F.lit(0))
    each = texts.select(*(c for c in texts.columns if c != "value"), F.posexplode(cases).alias("seq", "case"))
    fenced = F.regexp_extract("case", r"(?s)```[^\n]*\n(.*?)\n?```", 1)
    quoted = F.array_join(F.transform(F.regexp_extract_all("case", F.lit(r"(?m)^>([^\n]*)$"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, "^[> ]+", ""))), " ")
    planted, detected, missed = _items(F.col("case"), "심은"), _items(F.col("case"), "(?<!미)검출"), _items(F.col("case"), "미검출")
    truth = F.when(F.size(planted) > 0, planted).otherwise(distinct_items(F.concat(detected, missed)))
    text = F.trim(F.when(fenced != "", F.regexp_replace(fenced, "\n", " ")).otherwise(quoted))
    rest = [c for c in each.columns if c not in ("seq", "case")]
    out = each.select(*rest, "seq", F.regexp_extract("case", r"^### \[(\d+)\]", 1).alias("case_id"), F.trim(F.regexp_extract("case", r"^### \[\d+\]([^\n]*)", 1)).alias("title"), text.alias("text"), truth.alias("truth"))
    return out.where((F.col("text") != "") & (F.size("truth") > 0))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return reports(spark.read.text(path, wholetext=True))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, text, action): what isn't UTF-8 is blocked."""
    raw = spark.read.format("binaryFile").load(path)
    ok = F.expr("is_valid_utf8(cast(content as string))")
    return raw.select("path", F.when(ok, F.decode("content", "UTF-8")).alias("text"), F.when(ok, "scan").otherwise("block").alias("action"))


def sign_manifest(payload: dict, key: bytes) -> str:
    """HMAC of the canonical JSON; keys have 32 bytes at least."""
    if len(key) < 32:
        raise ValueError("a key of 32 bytes at least")
    return hmac.new(key, json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()


def verify_manifest(payload: dict, signature: str, key: bytes, contents: dict[str, bytes]) -> None:
    """Raises ValueError for a wrong signature or content."""
    if not hmac.compare_digest(sign_manifest(payload, key), signature):
        raise ValueError("wrong signature")
    for entry in payload.get("entries", []):
        if hashlib.sha256(contents[entry["name"]]).hexdigest() != entry["sha256"]:
            raise ValueError(f"{entry['name']}: wrong content")
