"""Policy and pin list as tables: decisions by equi-joins, so a plan stays as small with 100,000 pins as with one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES
from ..functions.text import keyed_hash
from .policy import Pin, Policy

#: Pins that are broadcast at most, some 150 bytes each. A longer list is joined by its key, and Spark splits the partitions of values that are found very often.
BROADCAST_PINS = 100_000
PINS = "seq long, hash string, category string, action string, label string"


def pin_table(spark: SparkSession, pins: Iterable[Pin]) -> DataFrame:
    """A pin list in its order. Longer ones come from a table with these columns."""
    return spark.createDataFrame([(k, p.hash, p.category, p.action, p.label) for k, p in enumerate(pins)], PINS)


def first_pins(pins: DataFrame) -> DataFrame:
    """(digest, category, pin): of pins with one hash and category the first; partial minima, then one row a key."""
    digest = F.regexp_replace("hash", "^sha256:", "").alias("digest")
    first = F.min_by(F.struct("action", "label", "hash"), "seq").alias("pin")
    return pins.where("hash is not null and category is not null").groupBy(digest, "category").agg(first)


def category_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """(category, floor, override, style, default): a row for each known category, and each that the policy names."""
    known = {c.name: c for c in CATEGORIES}
    rows = []
    for name in dict.fromkeys([*known, *policy.categories]):
        own, c = policy.categories.get(name), known.get(name)
        floor = own.min_confidence if own and own.min_confidence is not None else c.floor if c else 0.0
        rows.append((name, float(floor), own.action if own else None, (own.mask_style or "tokenize") if own and own.action else None, c.action if c else None))
    return spark.createDataFrame(rows, "category string, floor double, override string, style string, default string")


def decide_rows(found: DataFrame, policy: Policy, *, pins: DataFrame | None = None, key: bytes | None = None, category: str = "category", confidence: str = "confidence", original: str = "original", out: str = "decision") -> DataFrame:
    """found with out: struct(action, mask_style, effective_min_confidence, reason), as policy.decide() gives it: the floor, the first pin, the override, the default, and block for an
    unknown category. pins: as pin_table() makes them, in place of the policy's own; they count only with a key. A null category or confidence is decided like an unknown
    category's, and below no floor. Other columns pass, whatever they are called.
    """
    spark = found.sparkSession
    rows = found.select(F.struct(*(F.col(f"`{c}`") for c in found.columns)).alias("row"), F.col(f"`{category}`").alias("category"), F.col(f"`{confidence}`").cast("double").alias("confidence"), *([F.col(f"`{original}`").alias("original")] if key is not None else []))
    # As many rows as the policy file has categories.
    rows = rows.join(F.broadcast(category_table(spark, policy)), "category", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    below = F.coalesce(F.col("confidence") < F.col("floor"), F.lit(False))
    pin = F.lit(None).cast("struct<action:string,label:string,hash:string>")
    if key is not None and (pins is not None or policy.pins):
        first = first_pins(pins if pins is not None else pin_table(spark, policy.pins))
        few = (pins if pins is not None else pin_table(spark, policy.pins)).limit(BROADCAST_PINS + 1).count() <= BROADCAST_PINS
        # What is below its floor needs no digest; null digests meet nothing.
        rows = rows.withColumn("digest", F.when(~below, keyed_hash(F.col("original"), key)))
        rows = rows.join(F.broadcast(first) if few else first, ["digest", "category"], "left")
        pin = F.col("pin")

    def answer(action: Column | str, style: Column | str, reason: Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(action).alias("action"), lit(style).alias("mask_style"), F.col("floor").alias("effective_min_confidence"), reason.alias("reason"))

    label = F.concat(F.lit("pin_list:"), F.when(F.length(pin["label"]) > 0, pin["label"]).otherwise(F.substring(pin["hash"], 1, 12)))
    decision = (
        F.when(below, answer("allow", "tokenize", F.lit("below_min_confidence")))
        .when(pin.isNotNull(), answer(pin["action"], "tokenize", label))
        .when(F.col("override").isNotNull(), answer(F.col("override"), F.col("style"), F.concat(F.lit("category_override:"), "category")))
        .when(F.col("default").isNotNull(), answer(F.col("default"), "tokenize", F.concat(F.lit("category_default:"), "category")))
        .otherwise(answer("block", "tokenize", F.concat(F.lit("unknown_category:"), F.coalesce("category", F.lit("")))))
    )
    return rows.select("row", decision.alias("decision")).select(*(F.col(f"row.`{c}`") for c in found.columns), F.col("decision").alias(out))


def apply_rows(found: DataFrame, policy: Policy, by: Sequence[str], order: str, **options) -> DataFrame:
    """A row per group of findings (a document, say): enforced (those whose action isn't allow, with their decided action and style), suppressed (those that are allowed), both
    as arrays of struct(idx, finding, decision) in the order given, decisions (all, by index), enforced_count, suppressed_count and rate (0 for none). options: for
    decide_rows().
    """
    rows = decide_rows(found, policy, out="__decision", **options)
    finding = F.struct(*(F.col(f"`{c}`") for c in found.columns if c not in by)).alias("finding")
    every = F.array_sort(F.collect_list(F.struct(F.col(f"`{order}`").alias("order"), finding, F.col("__decision").alias("decision"))))
    numbered = F.transform(every, lambda x, k: F.struct(k.alias("idx"), x["finding"].alias("finding"), x["decision"].alias("decision")))
    out = rows.groupBy(*by).agg(numbered.alias("decisions"))
    allowed = lambda x: x["decision"]["action"] == "allow"
    out = out.withColumn("enforced", F.filter("decisions", lambda x: ~allowed(x))).withColumn("suppressed", F.filter("decisions", allowed))
    return out.withColumn("enforced_count", F.size("enforced")).withColumn("suppressed_count", F.size("suppressed")).withColumn("rate", F.col("enforced_count") / F.size("decisions"))
