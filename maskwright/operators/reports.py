"""Reports that merge: a row per day and cell with counts and sketches, from which any span of days, and any subtotal, follows without the findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of 2) of the sketch of different values, for an error of 1.6 % (one standard deviation), and entries of the sketch of frequent ones.
REGISTERS, FREQUENT = 12, 256


def daily(found: DataFrame, day: str, by: Sequence[str], value: str) -> DataFrame:
    """found: a row per finding. A row per day and cell: n, values (a sketch of the different values), top (a sketch of the most frequent ones). The sketches hold hashes and
    values: pass a keyed hash as value where values must not be kept."""
    v = F.col(value).cast("string")
    return found.groupBy(day, *by).agg(F.count("*").alias("n"), F.hll_sketch_agg(v, REGISTERS).alias("values"), F.call_function("approx_top_k_accumulate", v, F.lit(FREQUENT)).alias("top"))


def merged(days: DataFrame, by: Sequence[str], *, subtotals: bool = True, top: int = 10) -> DataFrame:
    """Days to one row per cell or, with subtotals, per cell of a rollup (null: all): n, values (about how many different ones), top (the most frequent ones with their counts). Rows of
    daily() that were written at any time merge alike."""
    groups = days.rollup(*by) if subtotals else days.groupBy(*by)
    return groups.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("values")).alias("values"), F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("top"), F.lit(FREQUENT)), F.lit(top)).alias("top"))
