"""What a scan costs: texts are searched once, and by all cores."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detect as D
from maskwright.plans import catalog, more  # noqa: F401

#: A pattern is in the plan six times for each scan: a test, three groups (one also for its size), and a split.
SCAN = 6


def scans(frame) -> float:
    spark = frame.sparkSession
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return frame._jdf.queryExecution().optimizedPlan().toString().count("GOCSPX") / SCAN
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_a_summary_scans_once(spark):
    rows = spark.createDataFrame([("mail a@example.org, b@example.org, card 4532015112830366",), ("nothing",), (None,)], "text string")
    s = rows.select(D.summary(D.detect(F.col("text"))).alias("s")).select("s.total", F.col("s.by_category")["EMAIL"].alias("mails"), F.col("s.by_action")["block"].alias("blocked"), "s.has_blocks", "s.has_masks")
    assert scans(s) == 1
    assert [tuple(r) for r in s.collect()] == [(3, 2, 1, True, True), (0, None, None, False, False), (0, None, None, False, False)]


@pytest.mark.parametrize("name", ["scan_summary", "corpus_floors", "corpus_precision"])
def test_one_file_is_the_work_of_all_cores(spark, name):
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert scans(rows) == 1
    assert f"roundrobinpartitioning({3 * spark.sparkContext.defaultParallelism})" in rows._jdf.queryExecution().executedPlan().toString().lower()
