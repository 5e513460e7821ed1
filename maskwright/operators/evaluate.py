"""Precision and recall of detections, gates for rule changes, scoring of replayed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECRETS = ["API_KEY", "TOKEN", "AWS_SECRET", "GCP_KEY", "PRIVATE_KEY", "PASSWORD"]


def ratio(part: Column, whole: Column) -> Column:
    """An empty denominator is 1; 4 decimals."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(1.0)), 4)


def precision_recall(samples: DataFrame) -> DataFrame:
    """samples: category, is_positive, detected. tp, fn, fp, recall and precision per category."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rows = samples.groupBy("category").agg(
        count(F.col("is_positive") & F.col("detected")).alias("tp"), count(F.col("is_positive") & ~F.col("detected")).alias("fn"), count(~F.col("is_positive") & F.col("detected")).alias("fp")
    )
    return rows.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def macro_f1(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.round(F.avg(f1(F.col("precision"), F.col("recall"))), 4).alias("macro_f1"))


def adoption_gate(candidate: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Metrics by threshold and category. Per threshold: passes if no category's recall drops by more than the tolerance, and
    either the organisations' precision rises or the macro F1 doesn't fall."""
    both = candidate.alias("c").join(baseline.alias("b"), ["threshold", "category"])
    org = F.col("category") == "ORGANIZATION"
    rows = both.groupBy("threshold").agg(
        F.bool_and(F.col("c.recall") >= F.col("b.recall") - tolerance).alias("recall_kept"),
        F.coalesce(F.bool_or(org & (F.col("c.precision") > F.col("b.precision"))), F.lit(False)).alias("org_better"),
        (F.avg(f1(F.col("c.precision"), F.col("c.recall"))) >= F.avg(f1(F.col("b.precision"), F.col("b.recall")))).alias("f1_kept"),
    )
    return rows.withColumn("passes", F.col("recall_kept") & (F.col("org_better") | F.col("f1_kept")))


def below_floors(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """floors: category, min_recall, min_precision."""
    return metrics.join(floors, "category").where((F.col("recall") < F.col("min_recall")) | (F.col("precision") < F.col("min_precision")))


def compatible(truth: Column, found: Column) -> Column:
    return (truth == found) | (truth.isin(*SECRETS) & found.isin(*SECRETS)) | (truth.isin("ADDRESS", "LOCATION") & found.isin("ADDRESS", "LOCATION"))


def folded(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"(?U)\s+", ""))


def score_case(truth: Column, found: Column) -> Column:
    """truth and found: array<struct<category, value>>. struct(tp, fn, fp): each truth in turn takes the first
    finding left that is compatible and contains it or is contained."""

    def matches(t: Column, d: Column) -> Column:
        a, b = folded(t["value"]), folded(d["value"])
        return compatible(t["category"], d["category"]) & (F.contains(a, b) | F.contains(b, a))

    def step(s: Column, t: Column) -> Column:
        hit = F.filter(F.transform(s["left"], lambda d, k: F.struct(k.alias("k"), matches(t, d).alias("ok"))), lambda x: x["ok"])
        at = F.get(hit, F.lit(0))["k"]
        left = F.when(at.isNull(), s["left"]).otherwise(F.filter(s["left"], lambda d, k: k != at))
        return F.struct((s["tp"] + at.isNotNull().cast("int")).alias("tp"), left.alias("left"))

    begin = F.struct(F.lit(0).alias("tp"), found.alias("left"))
    return F.aggregate(truth, begin, step, lambda s: F.struct(s["tp"].alias("tp"), (F.size(truth) - s["tp"]).alias("fn"), F.size(s["left"]).alias("fp")))


def micro(samples: DataFrame, category: str | None = None) -> DataFrame:
    """samples: truth and found, arrays of categories. One row: tp, fn, fp, recall, precision over all pairs of sample and category, or of one category."""
    only = (lambda c: F.filter(c, lambda x: x == category)) if category else (lambda c: c)
    t, f = only(F.array_distinct("truth")), only(F.array_distinct("found"))
    sums = samples.agg(*(F.coalesce(F.sum(F.size(x)), F.lit(0)).alias(n) for x, n in ((F.array_intersect(t, f), "tp"), (F.array_except(t, f), "fn"), (F.array_except(f, t), "fp"))))
    return sums.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def contribution(stage1: DataFrame, full: DataFrame) -> DataFrame:
    """Per category what a recogniser adds: recall_gain and precision_delta of full over stage1, to 4 decimals."""
    both = stage1.alias("a").join(full.alias("b"), "category")
    return both.select("category", F.round(F.col("b.recall") - F.col("a.recall"), 4).alias("recall_gain"), F.round(F.col("b.precision") - F.col("a.precision"), 4).alias("precision_delta"))


def fine_tune_gate(base: DataFrame, tuned: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: dropped, the categories whose recall falls by more than the tolerance, f1_delta of the macro F1, and passes."""
    both = base.alias("b").join(tuned.alias("t"), "category")
    f = lambda x: f1(F.col(f"{x}.precision"), F.col(f"{x}.recall"))
    # Recalls have 4 decimals.
    drop = F.when(F.round(F.col("b.recall") - F.col("t.recall"), 4) > tolerance, F.col("category"))
    out = both.agg(F.array_sort(F.collect_list(drop)).alias("dropped"), F.round(F.avg(f("t")) - F.avg(f("b")), 4).alias("f1_delta"))
    return out.withColumn("passes", (F.size("dropped") == 0) & (F.col("f1_delta") >= 0))


def distinct_items(items: Column) -> Column:
    """Of array<struct<category, value>> the first of each category and folded value, in order."""
    keys = F.transform(items, lambda x: F.struct(x["category"].alias("c"), folded(x["value"]).alias("v")))
    first = F.filter(F.transform(items, lambda x, k: F.struct(x.alias("x"), (F.array_position(keys, F.struct(x["category"].alias("c"), folded(x["value"]).alias("v"))) == k + 1).alias("new"))), lambda y: y["new"])
    return F.transform(first, lambda y: y["x"])


def replay_totals(scored: DataFrame, by: str) -> DataFrame:
    """scored: tp, fn, fp per case. Sums per data set or category, with recall and precision."""
    sums = scored.groupBy(by).agg(F.count("*").alias("cases"), *(F.sum(n).alias(n) for n in ("tp", "fn", "fp")))
    return sums.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def rendered(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(seq, line): the metrics as lines of a markdown table, in the order of the first column."""
    head = metrics.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "seq int, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    return head.unionByName(metrics.select((F.row_number().over(Window.orderBy(columns[0])) + 1).alias("seq"), line.alias("line")))
