"""Interval joins against all pairs, dictionaries against alternations, pins as a table."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators import intervals, matcher
from maskwright.operators import detect as D

SPANS = "doc long, start int, end int, name string"


def spans(rng, n, docs, far, longest):
    out = []
    for k in range(n):
        s = rng.randrange(far)
        out.append((rng.choice(docs), s, s + rng.choice([0, 1, 2, rng.randint(1, longest), rng.randint(1, 40)]), f"n{k}"))
    return out


@pytest.mark.parametrize("far, longest", [(200, 30), (100_000, 90_000), (10**7, 10**7)])
def test_overlaps_are_those_of_all_pairs(spark, far, longest):
    rng = random.Random(far)
    left, right = (spans(rng, 300, [1, 2, 3, None], far, longest) + [(1, None, 5, "x"), (1, 5, None, "y"), (1, 9, 3, "z")] for _ in range(2))
    a, b = (spark.createDataFrame(x, SPANS) for x in (left, right))
    good = lambda x: x[0] is not None and x[1] is not None and x[2] is not None and x[2] > x[1]
    pairs = [(x, y) for x in left if good(x) for y in right if good(y) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    rules = {"overlaps": lambda x, y: True, "contains": lambda x, y: x[1] <= y[1] and y[2] <= x[2], "inside": lambda x, y: y[1] <= x[1] and x[2] <= y[2]}
    for how, rule in rules.items():
        got = intervals.overlap_join(a, b, ["doc"], how=how)
        assert sorted((tuple(r.l), tuple(r.r)) for r in got.collect()) == sorted(p for p in pairs if rule(*p))


def test_no_cross_join_and_a_document_of_very_many_spans(spark):
    n = 100_000
    left = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 9).alias("end"))
    # One span is as long as the document: it meets all others, and nothing else does.
    right = left.select("doc", (F.col("start") + 3).alias("start"), (F.col("start") + 5).alias("end")).unionByName(spark.createDataFrame([(1, 0, 7 * n + 9)], "doc int, start long, end long"))
    out = intervals.overlap_join(left, right, ["doc"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = left.select("start", "end").toPandas()
    count = len(want)  # with the long one
    for a in (0, -1, 1):  # a span of 2 at 3, and the neighbour's that reaches 9
        other = want["start"] + 7 * a + 3
        count += int(((other >= 0) & (other <= 7 * (n - 1) + 3) & (other < want["end"]) & (other + 2 > want["start"])).sum())
    assert out.count() == count


def test_clashing_names_and_empty_tables(spark):
    a = spark.createDataFrame([(1, 0, 5, "a")], "doc long, start int, end int, l string")
    b = spark.createDataFrame([(1, 4, 6, "b")], "doc long, start int, end int, l string")
    assert [(r.l.l, r.r.l) for r in intervals.overlap_join(a, b, ["doc"]).collect()] == [("a", "b")]
    assert intervals.overlap_join(a.where("false"), b, ["doc"]).collect() == [] and intervals.overlap_join(a, b.where("false"), ["doc"]).collect() == []
    with pytest.raises(ValueError):
        intervals.overlap_join(a, b, ["doc"], how="near")


def test_dictionary_finds_what_the_alternations_find(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abé한") for _ in range(rng.randint(1, 4))): rng.choice(["x", "y", "z"]) for _ in range(60)}
    texts = ["".join(rng.choice("abé한 ") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "🙂한ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    both = matcher.with_entities(docs, words).withColumn("by_pattern", D.dictionary_entities(F.coalesce("text", F.lit("")), words))
    for r in both.collect():
        key = lambda e: (e.start, e.end, e.label, e.text, e.score)
        assert sorted(map(key, r.entities)) == sorted(map(key, r.by_pattern)), r.text
        assert all(r.text[e.start : e.end] == e.text for e in r.entities)


def test_time_does_not_follow_the_number_of_names(spark):
    names = [f"name{k:06d}x" for k in range(100_000)]
    text = " ".join(f"word{k} name{k * 37 % 100_000:06d}x" for k in range(20_000))
    took = []
    for n in (1000, 100_000):
        machine = matcher._automaton([(w, ("p",)) for w in names[:n]])
        began = time.process_time()
        found = matcher.literal_spans(text, machine)
        took.append(time.process_time() - began)
        assert len(found) == sum(k * 37 % 100_000 < n for k in range(20_000))
    assert took[1] < 8 * took[0] + 0.2  # 100 times the names, and 100 times the findings
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    assert matcher.with_entities(docs, dict.fromkeys(names, "p")).select(F.size("entities").alias("n")).first().n == 20_000


def test_large_dictionaries_take_several_passes(spark, monkeypatch):
    words = {f"w{k}": f"label{k % 5}" for k in range(50)} | {"w1 w2": ("label0", "label9"), "": "none"}
    docs = spark.createDataFrame([(1, "w1 w2 w33 w4")], "id long, text string")
    whole = matcher.with_entities(docs, words).first().entities
    monkeypatch.setattr(matcher, "MOST", 20)
    assert len(list(matcher._parts(words))) > 2 and matcher.with_entities(docs, words).first().entities == whole
    assert {(e.text, e.label) for e in whole} >= {("w1 w2", "label0"), ("w1 w2", "label9"), ("w33", "label3")}
    with pytest.raises(ValueError):
        matcher.with_entities(docs, {}, out_col="text")
    assert matcher.with_entities(docs, {}).first().entities == []


def test_allowed_values_go(spark):
    docs = spark.createDataFrame([(1, "to ann@example.org and bob@corp.io"), (2, None)], "id long, text string").withColumn("detections", D.detect(F.col("text")))
    got = {r.id: [d.original for d in r.detections] for r in matcher.without_allowed(docs, ["example.org", "nothing"]).collect()}
    assert got == {1: ["bob@corp.io"], 2: []}
    assert re.match("to ann", matcher.without_allowed(docs, []).where("id = 1").first().text)
