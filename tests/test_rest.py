"""Policy files, pin lists, the ledger's folders, training data, reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import detect as D
from maskwright.operators import evaluate as E
from maskwright.operators import policy as Pol
from maskwright.operators import training as Tr
from maskwright.sources import ledger as L


def put(path, raw, step=[0]):
    path.write_text(raw if isinstance(raw, str) else json.dumps(raw))
    step[0] += 1
    os.utime(path, ns=(step[0] * 10**9, step[0] * 10**9))


def test_policy_file_keeps_the_last_good_one(tmp_path):
    path = tmp_path / "policy.json"
    file = Pol.PolicyFile(str(path))
    assert file.policy.setting("fail_mode") == "closed" and file.problem
    put(path, {"fail_mode": "open"})
    assert file.reload() and file.policy.setting("fail_mode") == "open" and not file.reload()
    for bad in ("{", {"fail_mode": "ajar"}, {"what": 1}, [], {"proximity": {"window": 201}}, {"stage2": {"memory_mb": 64}}, {"channel_overrides": {"agent": {"x": "y"}}}, {"pin_list": [{"hash": "a", "category": "EMAIL", "action": "x"}]}, {"allowlist": ["("]}, {"categories": {"EMAIL": {"x": 1}}}):
        put(path, bad)
        assert not file.reload() and file.problem and file.policy.setting("fail_mode") == "open", bad
    pins = {"pin_list": [{"hash": "a", "category": "EMAIL", "action": "allow"}]}
    # The rest of a file whose pins aren't approved counts.
    put(path, pins | {"unscannable_action": "ocr"})
    assert file.reload() and not file.policy.pins and "approved" in file.problem and file.policy.setting("unscannable_action") == "ocr"
    put(path, pins | {"pin_list_approved": True})
    assert file.reload() and [p.hash for p in file.policy.pins] == ["a"] and not file.problem
    path.unlink()
    assert file.reload() and not file.policy.pins and not file.reload()
    # A file that comes back has the approval of the list that it had, and no other.
    other = {"pin_list": [{"hash": "b", "category": "CARD", "action": "allow"}]}
    put(path, other)
    assert file.reload() and not file.policy.pins and "approved" in file.problem
    put(path, pins | {"fail_mode": "open"})
    assert file.reload() and [p.hash for p in file.policy.pins] == ["a"] and not file.problem
    put(path, other)
    first = Pol.PolicyFile(str(path))
    assert not first.policy.pins and "approved" in first.problem


def test_pins(tmp_path):
    a, b = Pol.Pin("a", "EMAIL", "allow"), Pol.Pin("b", "CARD", "block")
    assert Pol.guard_pins([a, b], [b, a], "agent").allowed and not Pol.guard_pins([a], [b], "agent", True).allowed
    assert not Pol.guard_pins([a], [b], "file").allowed and Pol.guard_pins([a], [b], "file", True).allowed
    path = str(tmp_path / "p.json")
    gate = Pol.PinApproval(path)
    with pytest.raises(ValueError):
        gate.approve()
    assert gate.propose([a]) == {"added": ["a"], "removed": []} and gate.state == "staged"
    gate.approve()
    assert gate.state == "committed" and [p.hash for p in Pol.PolicyFile(path).policy.pins] == ["a"]
    other, late = Pol.PinApproval(path), Pol.PinApproval(path)
    assert other.propose([b]) == {"added": ["b"], "removed": ["a"]}
    late.propose([])
    other.approve()
    with pytest.raises(ValueError):
        late.approve()
    late.reject()
    assert late.state == "rejected"


def test_ledger_folder(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(f"2026-01-{d:02d}T00:00:00Z", "mask") for d in range(1, 13)], "timestamp string, event_type string")
    L.append(rows, folder)
    assert L.purge(spark, folder, "2026-01-03") == ["2026-01-01", "2026-01-02"]
    assert L.rotate(spark, folder, keep=7) == ["2026-01-03", "2026-01-04", "2026-01-05"]
    assert spark.read.json(folder).count() == 7 and L.rotate(spark, folder, most_bytes=1)[-1] == "2026-01-11" and spark.read.json(folder).count() == 1
    assert L.rotate(spark, str(tmp_path / "none")) == [] and L.purge(spark, str(tmp_path / "none"), "2026") == []


def test_training(spark, tmp_path):
    rows = Tr.augmented(spark, 70, 33)
    assert rows.collect() == Tr.augmented(spark, 70, 33).collect() and rows.where(F.size("spans") == 3).count() == 70
    parts = {r.split: r["count"] for r in Tr.split(rows, "doc_id").groupBy("split").count().collect()}
    assert parts == {"train": 82, "val": 10, "test": 11}
    assert Tr.split(rows.where("false"), "doc_id").count() == 0
    labelled = rows.select("text", F.transform("spans", lambda s: F.array(s["start"].cast("string"), s["end"].cast("string"), s["label"])).alias("spans"))
    examples, stats = Tr.ingest(labelled)
    s = stats.first()
    assert (s.in_docs, s.out_examples, s.rejected, s.spans, s.span_map_failures, s.negative_examples, s.errors) == (103, 103, 0, 210, 0, 33, [])
    one = examples.where(F.size("ner") > 0).first()
    person = next(n for n in one.ner if n.label == "PERSON")
    assert one.tokenized_text[person.first : person.last + 1] == [one.text[one.spans[0].start : one.spans[0].end]]
    Tr.write_jsonl(examples, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 103
    (tmp_path / "raw.jsonl").write_text('{"text":"a b","spans":[[0,1,"PERSON"]]}\n\nnot json\n{"text":5}\n')
    assert Tr.ingest(Tr.read_jsonl(spark, str(tmp_path / "raw.jsonl")))[1].first().rejected == 1


def test_recogniser(spark):
    rows = spark.createDataFrame([("김민수는 서울 AWS", 1)], "text string, k int")
    e = D.dictionary_entities(F.col("text"), {"김민수는": "person", "AWS": "firm"})
    got = rows.select(D.scan(F.col("text"), e, {"person": "PERSON", "firm": "ORGANIZATION"}).alias("s")).first().s
    assert [(d.category, d.original, d.start, d.end) for d in got.detections] == [("PERSON", "김민수", 0, 3)] and not got.coverage_gap
    weak = F.transform(e, lambda x: x.withField("score", F.lit(0.4)))
    assert rows.select(D.entities_to_detections(weak, {"person": "PERSON"}).alias("d")).first().d == []
    gone = rows.select(D.scan(F.col("text"), F.lit(None).cast("array<struct<start:int,end:int,label:string,score:double,text:string>>"), {"person": "PERSON"}).alias("s")).first().s
    assert gone.coverage_gap and gone.stage2_gap_reason


def test_items_and_reports(spark):
    items = spark.createDataFrame([([("EMAIL", "a b"), ("CARD", "AB"), ("EMAIL", "AB"), ("CARD", "c")],)], "i array<struct<category:string,value:string>>")
    assert [tuple(x) for x in items.select(E.distinct_items(F.col("i")).alias("d")).first().d] == [("EMAIL", "a b"), ("CARD", "AB"), ("CARD", "c")]
    report = spark.createDataFrame([("### [7] T\n> one\n> two\n- 심은: —\n- 검출: `EMAIL` = a@b.io, `CARD` = 1, 2\n",)], "value string")
    case = L.reports(report).first()
    assert (case.case_id, case.text, [tuple(t) for t in case.truth]) == ("7", "one two", [("EMAIL", "a@b.io"), ("CARD", "1, 2")])


def test_sql_functions(spark):
    T.register(spark)
    assert tuple(spark.sql("SELECT mw_digits('４5-x'), mw_luhn('4532 0151 1283 0366'), mw_acct_len_ok('12-345 6789'), mw_unbracket('[A]'), mw_unbracket('A'), mw_fingerprint(' A\tb ')").first()) == ("45", True, True, "A", None, spark.sql("SELECT sha1('a b')").first()[0])
