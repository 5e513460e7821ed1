"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys, are range-sorted by them within their source, distributed prefix sums
give each document the tokens before it, and each source is cut at its exact budget; a budget beyond
the source's size repeats whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, write_once


#: Up to so many sources, about 1 MB, the plan goes to every task; beyond, it is dealt with SALTS copies of each of its rows, so that a
#: source's documents are in as many tasks.
BROADCAST_SOURCES, SALTS = 10_000, 64


def cycling_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the source's rank from 0."""
    return (F.pmod(rank, F.lit(3)) + 1).cast("double")


def mix_to_weights(docs: DataFrame, *, weight=cycling_weight, total: float | None = None, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    size: words of the text (null: 0). weight: a column of the source's rank, by code point, null last. The sources
    share total (all sizes, if none is given) by weight; a target stops at max_epochs times its source's size, and the
    excess is shared again by weight. A source of size 0 takes nothing. taken: what the mix takes of the document, whole epochs
    and, in the last one, all of it, none, or, for the document at the cut, its first words; per source it sums to the rounded target.
    The keys depend on seed, id and size only, so reruns agree. row_col: a column that tells rows apart whose ids are equal; it comes back
    as row. Empty tables give an empty result.

    The table per source has a row for each source, of some 100 bytes, and is made in one task: millions of sources (hosts) fit, billions don't. The
    sums per range of a source are made in one task, too: it has as many ranges as rows in each, so neither grows faster than the root of its rows.
    Documents are never dealt by source.
    """
    row = [] if row_col is None else ["row"]
    sizes = docs.select(
        *(F.col(f"`{row_col}`").alias(r) for r in row),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # Both the sums and the cut read this slim table, so texts are counted once.
    keyed = write_once(
        sizes.withColumns({
            "no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")),
            "key": F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))), 1, 16),
        }),
        "mix-sizes",
    )
    by_source = keyed.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = write_once(_targets(by_source, weight, total, max_epochs), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        planned = keyed.join(F.broadcast(plan), ["no_source", "name"])
    else:
        copies = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        planned = keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(copies, ["no_source", "name", "salt"]).drop("salt")
    # Keys are uniform, so ranges of equal width hold about as many rows each, however large the source.
    share = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    ranged = planned.withColumn("range", F.least(F.floor(share * F.col("n_ranges")), F.col("n_ranges") - 1).cast("long"))
    # Dealt by range as well: else the windows below would take the join's partitioning, with a whole source in one task.
    ranged = ranged.repartition("no_source", "name", "range")
    sums = ranged.groupBy("no_source", "name", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("no_source", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("no_source", "name", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("no_source", "name", "range").orderBy("key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("prefix", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["no_source", "name", "range"])
    left = F.col("rest") - (F.col("range_start") + F.col("prefix"))
    return placed.select(
        *row, "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long").alias("taken"),
    )


def _targets(by_source: DataFrame, weight, total: float | None, max_epochs: int) -> DataFrame:
    """Water filling in closed form: sources in ascending order of cap / weight stop at their caps as long as
    a cap is not above its weight's share of what the ones before it leave."""
    ranked = by_source.withColumn("w", weight(F.row_number().over(Window.orderBy("no_source", "name")) - 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "name")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = F.lit(float(total)) if total is not None else F.sum("source_size").over(every).cast("double")
    level = (share - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later)
    filled = ranked.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    open_level = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    filled = filled.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(open_level * F.col("w")))
    budget = F.least(F.round("target"), F.col("cap")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    return filled.select(
        "no_source", "name", "source_size", "target", epochs.alias("epochs"),
        (budget - epochs * F.col("source_size")).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.sqrt("n_rows"))).cast("long").alias("n_ranges"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; null texts have size 0 and take nothing, null sources are one source. An empty table gives no rows."""
    return mix_to_weights(table(spark, sf_dir, "documents")).drop("source")


OP2_SQL = r"""
WITH s AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), b AS (SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY ALL),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY no_source, name) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM b),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, no_source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, no_source, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (SELECT *, CASE WHEN cap <= level * w THEN cap ELSE max(CASE WHEN cap > level * w THEN level END) OVER () * w END AS target FROM l),
p AS (SELECT *, CAST(least(round(target), cap) AS BIGINT) AS budget FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
k AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY no_source, name ORDER BY substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 16), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM s JOIN q USING (no_source, name)
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(rest - coalesce(before, 0), size)) AS BIGINT) AS taken FROM k
"""


def brute_targets(sizes: list[int], weights: list[float], max_epochs: int = 3) -> list[float]:
    """The same targets by repeated sharing, for tests."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        w = math.fsum(weights[i] for i in open_)
        full = {i for i in open_ if sizes[i] * max_epochs <= left * weights[i] / w}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(sizes[i] * max_epochs)
        left -= sum(out[i] for i in full)
        open_ -= full
    return out
