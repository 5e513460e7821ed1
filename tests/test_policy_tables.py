"""Decisions by joins equal decide(), whatever the pins' number; the policy reaches scan and scrub."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from maskwright.operators import payloads as P
from maskwright.operators import policy as Pol
from maskwright.operators import policy_tables as Tab
from maskwright.operators.detect import detect

KEY = b"a key of 32 bytes or more for tests only"


def digest(value: str) -> str:
    return hmac.new(KEY, value.strip().lower().encode(), hashlib.sha256).hexdigest()


POLICY = Pol.Policy(
    categories={"EMAIL": Pol.CategoryPolicy(action="mask", mask_style="partial"), "PHONE": Pol.CategoryPolicy(min_confidence=0.5), "OWN": Pol.CategoryPolicy(action="allow")},
    pins=[Pol.Pin("sha256:" + digest("a@x.org"), "EMAIL", "allow", "first"), Pol.Pin(digest("a@x.org"), "EMAIL", "block", "second"), Pol.Pin(digest("77"), "CARD", "mask"), Pol.Pin(digest("low"), "PHONE", "block", "low")],
)
ROWS = [("EMAIL", 0.95, "A@x.org "), ("EMAIL", 0.95, "b@x.org"), ("EMAIL", 0.0, "a@x.org"), ("CARD", 0.99, "77"), ("CARD", 0.99, "78"), ("PHONE", 0.4, "low"), ("PHONE", 0.6, "low"), ("OWN", 0.1, "x"), ("NEW", 0.1, "y"), ("EMAIL", 0.95, None)]


def test_joins_decide_as_the_expression_does(spark):
    found = spark.createDataFrame([(k, *r, "seq") for k, r in enumerate(ROWS)], "id long, category string, confidence double, original string, pin string")
    for key in (KEY, None):
        want = {r.id: tuple(r.p) for r in found.select("id", Pol.decide(F.col("category"), F.col("confidence"), F.col("original"), POLICY, key).alias("p")).collect()}
        got = Tab.decide_rows(found, POLICY, key=key)
        assert {r.id: tuple(r.decision) for r in got.collect()} == want and got.columns == [*found.columns, "decision"]
    odd = spark.createDataFrame([(None, None, None)], "category string, confidence double, original string")
    assert Tab.decide_rows(odd, POLICY, key=KEY).first().decision.action == "block"


def test_many_pins_and_a_plan_of_constant_size(spark):
    rows = spark.range(3000).select("id", F.lit("EMAIL").alias("category"), F.lit(0.95).alias("confidence"), F.when(F.col("id") % 3 == 0, "hot@x.org").otherwise(F.concat(F.lit("user"), F.col("id").cast("string"))).alias("original"))
    some = Pol.Policy(categories=POLICY.categories)
    sizes = []
    for n in (10, 100_001):  # the second is beyond what is broadcast
        pins = spark.range(n).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("EMAIL").alias("category"), F.lit("allow").alias("action"), F.lit("").alias("label"))
        pins = pins.unionByName(Tab.pin_table(spark, [Pol.Pin(digest("hot@x.org"), "EMAIL", "block", "hot"), Pol.Pin(digest("user4"), "EMAIL", "allow", "four")]))
        out = Tab.decide_rows(rows, some, pins=pins, key=KEY)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        got = {r.reason: r["count"] for r in out.groupBy("decision.reason").count().collect()}
        assert got == {"pin_list:hot": 1000, "pin_list:four": 1, "category_override:EMAIL": 1999}
    assert abs(sizes[1] - sizes[0]) < 300


def test_layer_reports_enforced_and_suppressed(spark):
    found = spark.createDataFrame([(1, k, *r) for k, r in enumerate(ROWS[:4])] + [(2, 0, *ROWS[7])], "doc long, at int, category string, confidence double, original string")
    got = {r.doc: r for r in Tab.apply_rows(found, POLICY, ["doc"], "at", key=KEY).collect()}
    assert [x.idx for x in got[1].enforced] == [1, 3] and [(x.idx, x.decision.reason) for x in got[1].suppressed] == [(0, "pin_list:first"), (2, "below_min_confidence")]
    assert (got[1].enforced_count, got[1].suppressed_count, got[1].rate, got[2].rate) == (2, 2, 0.5, 0.0) and len(got[1].decisions) == 4
    assert got[1].enforced[0].finding.original == "b@x.org" and got[1].enforced[0].decision.mask_style == "partial"


def test_policy_reaches_scan_and_scrub(spark):
    p = Pol.load_policy({
        "allowlist": [r"@corp\.io$"], "categories": {"EMAIL": {"action": "mask", "mask_style": "partial"}}, "unknown_field_action": "block", "channel_overrides": {"agent": {"unknown_field_action": "warn_allow", "unscannable_action": "warn_allow"}},
        "proximity": {"account_triggers": ["wire to"], "window_chars": 10, "password_keywords": ["geheimwort"]},
    })
    options = Pol.scan_options(p)
    text = "mail ann@example.org, kim@corp.io; wire to 123-456-789012; geheimwort: Tree-42x, far away from all words 123-456-789013"
    got = spark.createDataFrame([(text,)], "text string").select(detect(F.col("text"), **options).alias("d")).first().d
    assert [d.original for d in got] == ["ann@example.org", "123-456-789012", "Tree-42x"]
    off = Pol.scan_options(Pol.load_policy({"proximity": {"enabled": False}}))
    assert [d.original for d in spark.createDataFrame([(text,)], "text string").select(detect(F.col("text"), **off).alias("d")).first().d] == ["ann@example.org", "kim@corp.io"]
    body = json.dumps({"messages": [{"content": [{"type": "text", "text": "ann@example.org kim@corp.io"}, {"type": "image"}, {"type": "new"}]}]})
    rows = spark.createDataFrame([(1, "claude", body)], "request_id long, provider string, payload string")
    strict, agent = P.scrub(rows, policy=p).first(), P.scrub(rows, policy=p, channel="agent").first()
    assert strict.block and not agent.block
    assert json.loads(agent.masked)["messages"][0]["content"][0]["text"] == "an***rg kim@corp.io"
