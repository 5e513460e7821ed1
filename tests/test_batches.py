"""Policies that change between batches, audit trails of repeated batches, models that are slow or crash."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from maskwright.operators import detect as D
from maskwright.operators import policy as Pol
from maskwright.operators import recogniser as R
from maskwright.sources import ledger as L
from maskwright.streaming import batches as B

# Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEY = b"a key of 32 bytes or more for tests only"


def put(path, value, at):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    os.utime(path, (at, at))


def test_policy_changes_between_batches(spark, tmp_path):
    """A stream over three files; the policy changes after the first batch, and is bad after the second."""
    path, out = tmp_path / "policy.json", []
    now = time.time() - 1000
    put(path, {"categories": {"EMAIL": {"action": "allow"}}}, now)
    after = [{"categories": {"EMAIL": {"action": "block"}}}, "{ not json"]

    def apply(batch, policy):
        return batch.select("id", Pol.decide(F.lit("EMAIL"), F.lit(0.99), F.col("value"), policy)["action"].alias("action"))

    def sink(rows, batch_id):
        out.append((batch_id, sorted((r.id, r.action) for r in rows.collect()), rows.first().policy_digest, rows.first().policy_problem))
        if batch_id < 2:
            put(path, after[batch_id], now + batch_id + 1)

    for k in range(3):
        spark.createDataFrame([(k, "ann@example.org")], "id long, value string").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("id long, value string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    query = source.writeStream.foreachBatch(B.PolicyBatches(str(path), apply, sink)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and [o[0] for o in out] == [0, 1, 2]
    assert [a for _, rows, _, _ in out for _, a in rows] == ["allow", "block", "block"]
    assert out[0][2] != out[1][2] == out[2][2] and out[0][3] is None and out[1][3] is None and out[2][3]


def test_policy_that_is_being_written_waits(spark, tmp_path):
    path, got = tmp_path / "p.json", []
    put(path, {"fail_mode": "open"}, time.time() - 100)
    step = B.PolicyBatches(str(path), lambda b, p: b.withColumn("mode", F.lit(p.setting("fail_mode"))), lambda rows, k: got.append(rows.first().mode), settle_ms=60_000)
    step(spark.range(1).toDF("id"), 0)
    put(path, {"fail_mode": "closed"}, time.time())
    step(spark.range(1).toDF("id"), 1)
    os.utime(path, (time.time() - 90, time.time() - 90))
    step(spark.range(1).toDF("id"), 2)
    assert got == ["open", "open", "closed"]


def found(batch):
    rows = batch.withColumn("d", F.explode(D.detect(F.col("text")))).withColumn("ts", F.to_timestamp("at"))
    return L.entries(rows, KEY, channel="agent")


def test_audit_of_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = lambda *x: spark.createDataFrame(x, "at string, text string")
    sink = B.AuditSink(folder, found, name="q")
    first = rows(("2026-01-01 10:00:00", "to ann@example.org"), ("2026-01-02 10:00:00", "card 4532015112830366"))
    sink(first, 0)
    sink(rows(("2026-01-02 11:00:00", "to bob@corp.io")), 1)
    sink(first, 0)  # again, as after a failure before the commit
    every = spark.read.json(folder)
    assert every.count() == 3 and sorted(r.n for r in every.groupBy("batch").agg(F.count("*").alias("n")).collect()) == [1, 2]
    raw = " ".join(r.value for r in spark.read.text(f"{folder}/*/*").collect())
    assert not any(v in raw for v in ("ann@example.org", "4532015112830366", "bob@corp.io"))
    with pytest.raises(ValueError):
        B.AuditSink(folder, lambda b: found(b).withColumn("original", F.lit("x")), name="q")(first, 2)
    with pytest.raises(ValueError):
        B.AuditSink(folder, found)(first, 2)
    B.AuditSink(folder, found, name="q", keep=1)(rows(("2026-01-05 10:00:00", "to ann@example.org")), 3)
    assert {str(r.day) for r in spark.read.json(folder).select("day").collect()} == {"2026-01-05"}
    ts = spark.createDataFrame([("2026-01-05 10:00:00", "stage2_ner", "recogniser timed out", "messages[0]", "block")], "t string, stage string, reason string, scan_field string, action string").withColumn("ts", F.to_timestamp("t"))
    B.AuditSink(folder, L.failure_entries, name="f")(ts, 0)
    B.AuditSink(folder, L.gap_entries, name="g")(ts, 0)
    got = {r.event_type: r for r in spark.read.json(folder).where("event_type <> 'mask'").collect()}
    assert got["fail"].fail_reason == "recogniser timed out" and (got["coverage_gap"].reason, got["coverage_gap"].scan_field, got["coverage_gap"].action) == ("recogniser timed out", "messages[0]", "block")


def test_audit_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, schema = str(tmp_path / "ledger"), "at string, text string"
    for k in range(2):
        spark.createDataFrame([(f"2026-01-0{k + 1} 10:00:00", f"to user{k}@example.org")], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
        query = source.writeStream.foreachBatch(B.AuditSink(folder, found)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert spark.read.json(folder).count() == 2


class Names:
    """Finds a name; sleeps, crashes, fails or answers out of shape on request."""

    def __init__(self):
        self.calls = 0

    def entities(self, texts):
        self.calls += 1
        print("models print")
        out = []
        for t in texts:
            if "SLEEP" in t:
                time.sleep(60)
            if "CRASH" in t:
                os._exit(9)
            if "RAISE" in t:
                raise ValueError("x")
            if "SHORT" in t:
                return []
            at = t.find("김민수")
            out.append([{"start": at, "end": at + 3, "label": "person", "score": 0.9}] if at >= 0 else [])
        return out


def broken():
    raise RuntimeError("no weights")


TEXTS = ["담당 김민수 ann@example.org", "SLEEP bob@corp.io", "김민수", "CRASH bob@corp.io", "담당 김민수", "RAISE", "김민수 again", "SHORT", "김민수 at the end", None]


def make():
    return Names()


def test_slow_and_crashing_models_end_in_rules_and_a_reason(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    got = {r.id: r for r in R.scan_with(docs, make, {"person": "PERSON"}, limits={"time_limit": 3.0, "rows": 1}).collect()}
    values = {k: [d.original for d in r.scan.detections] for k, r in got.items()}
    assert values == {0: ["김민수", "ann@example.org"], 1: ["bob@corp.io"], 2: ["김민수"], 3: ["bob@corp.io"], 4: ["김민수"], 5: [], 6: ["김민수"], 7: [], 8: ["김민수"], 9: []}
    reasons = {k: r.scan.stage2_gap_reason for k, r in got.items() if r.scan.coverage_gap}
    assert reasons == {1: "recogniser timed out", 3: "recogniser crashed", 5: "recogniser gave a wrong answer", 7: "recogniser gave a wrong answer"}


def test_a_model_that_never_answers_is_given_up(spark):
    docs = spark.createDataFrame([(k, "text") for k in range(6)], "id long, text string").coalesce(1)
    got = [r.gap_reason for r in R.with_recogniser(docs, broken, rows=1).orderBy("id").collect()]
    assert got == ["recogniser can't be loaded"] * 3 + [f"recogniser is off after {R.FAILURES} failures: recogniser can't be loaded"] * 3


def test_backends():
    assert R.resolve_backend(None) == "gliner" and R.resolve_backend(None, "spaCy ") == "spacy" and R.resolve_backend("nunerzero", "spacy") == "nunerzero"
    for setting, policy in (("other", None), (None, "other")):
        with pytest.raises(ValueError):
            R.resolve_backend(setting, policy)
