"""The made-up corpus knows its own spans; floors and caps hold over the whole scan; reports merge over days."""

from pyspark.sql import functions as F

from maskwright.operators import reports as Rep
from maskwright.plans import corpus as Co


def test_spans_are_where_the_corpus_says(spark):
    rows = Co.texts(spark.range(1, 40))
    assert rows.where("category is not null and (value is null or substring(text, start + 1, end - start) <> value)").isEmpty()
    assert rows.where("text is null").isEmpty() and rows.select("tag").distinct().count() == len(Co.FORMATS) + len(Co.NEGATIVES)
    assert rows.collect() == Co.texts(spark.range(1, 40)).collect()
    only = Co.texts(spark.range(3), tags=["rrn_dash", "neg_rrn"])
    assert {r.tag for r in only.collect()} == {"rrn_dash", "neg_rrn"}


def test_floors_and_caps(spark):
    rows = Co.texts(spark.range(100, 160)).cache()
    formats = Co.by_format(rows).collect()
    assert all(r.ok for r in formats), [r for r in formats if not r.ok]
    assert sum(r.false_findings for r in formats if r.tag.startswith("neg_")) <= 3 * 60
    assert all(r.recall_ok and r.precision_ok for r in Co.by_category(rows).collect())


def test_reports_merge_over_days(spark):
    rows = spark.range(40_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("channel"), F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 9000).cast("string"))).alias("value"))
    daily = Rep.daily(rows, "day", ["channel"], "value")
    assert daily.count() == 14
    got = {r.channel: r for r in Rep.merged(daily, ["channel"], top=1).collect()}
    exact = {r.channel: r.v for r in rows.groupBy("channel").agg(F.count_distinct("value").alias("v")).collect()} | {None: rows.select("value").distinct().count()}
    for channel, r in got.items():
        # Four standard deviations of the sketch.
        assert abs(r["values"] - exact[channel]) <= 0.065 * exact[channel] and r.top[0].item == "hot"
    assert got[None].n == 40_000 and abs(got[None].top[0]["count"] - 10_000) <= 200
    # Days that come later merge with those that are there.
    one, two = Rep.daily(rows.where("day < 3"), "day", ["channel"], "value"), Rep.daily(rows.where("day >= 3"), "day", ["channel"], "value")
    assert {r.channel: (r.n, r["values"]) for r in Rep.merged(one.unionByName(two), ["channel"]).collect()} == {c: (r.n, r["values"]) for c, r in got.items()}
