"""Requests and responses, whole or broken, and streams cut anywhere."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.operators import payloads as P
from maskwright.streaming import lookahead as S

MAIL = "kim@corp.io"
ODD = [
    ("claude", '{"messages":[{"content":[{"type":"tool_result","content":5}]}]}', True), ("claude", '{"messages":["x"]}', True), ("claude", '{"messages":{}}', True), ("claude", '{"messages":[5]}', False),
    ("openai", '{"messages":[{"role":["a"],"content":"x","tool_calls":5}]}', True), ("openai", '{"messages":[{"tool_calls":[{"function":"x"}]}]}', True), ("openai", '{"messages":[{"tool_calls":[{"function":{"arguments":{}}}]}]}', False),
    ("openai", '{"messages":[{"content":["loose"]}]}', False), ("openai", '{"messages":"secret"}', True), ("gemini", '{"contents":[{"parts":[{"functionCall":"x"}]}]}', True), ("gemini", '{"contents":[{"parts":[{"text":5}]}]}', True),
    ("gemini", '{"contents":[{"parts":"x"}]}', True), ("gemini", '{"systemInstruction":{"parts":5}}', True), ("gemini", "[]", True), ("other", "{}", True), (None, None, True), ("claude", "{}", False),
    ("openai", '{"messages":[{"content":"\\ud800"}]}', True), ("openai", '{"messages":' + "[" * 200_000, True), ("claude", '{"messages":[{"content":"my card 4532015112830366"}]}', True),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, p, x) for k, (p, x, *_) in enumerate(rows)], "request_id long, provider string, payload string")


def test_whatever_comes_ends_in_an_answer(spark):
    got = {r.request_id: r.block for r in P.scrub(frame(spark, ODD)).collect()}
    assert got == {k: block for k, (_, _, block) in enumerate(ODD)}


def test_actions_and_masked_body(spark):
    body = {"system": [{"type": "text", "text": f"I am {MAIL}"}], "messages": [{"role": "user", "content": [{"type": "tool_use", "input": {"a": [f"to {MAIL}", 1, None]}}, {"type": "image"}, {"type": "new"}]}]}
    rows = frame(spark, [("claude", json.dumps(body))])
    strict, loose = P.scrub(rows).first(), P.scrub(rows, unknown_action="warn_allow", unscannable_action="warn_allow").first()
    assert strict.block and not loose.block and len(loose.gaps) == 2 and loose.n_detections == 2 and loose.restoration_map == {"EMAIL_1": MAIL}
    body["system"][0]["text"], body["messages"][0]["content"][0]["input"]["a"][0] = "I am [EMAIL_1]", "to [EMAIL_1]"
    assert json.loads(loose.masked) == body
    assert rows.select(P.rehydrate_json(F.lit(loose.masked), F.create_map(F.lit("EMAIL_1"), F.lit(MAIL)))).first()[0].count(MAIL) == 2


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids, with different numbers of fields: each row is masked by what it holds."""
    say = lambda *t: json.dumps({"messages": [{"content": x} for x in t]})
    rows = [(None, say(f"write to {MAIL}")), (None, say("nothing here")), (7, say("first")), (7, say("one", f"two {MAIL}", "card 4532015112830366")), (8, say(f"{MAIL}")), (8, say(f"x {MAIL}"))]
    docs = spark.createDataFrame([(i, "claude", x) for i, x in rows], "request_id long, provider string, payload string").repartition(3)
    got = sorted(([m["content"] for m in json.loads(r.masked)["messages"]], r.request_id, r.block, r.n_detections) for r in P.scrub(docs).collect())
    assert got == [(["[EMAIL_1]"], 8, False, 1), (["first"], 7, False, 0), (["nothing here"], None, False, 0), (["one", "two [EMAIL_1]", "card [CARD_1_BLOCKED]"], 7, True, 2), (["write to [EMAIL_1]"], None, False, 1), (["x [EMAIL_1]"], 8, False, 1)]


def test_what_cannot_be_masked_blocks(spark, monkeypatch):
    """No masked payload, no pass, whatever the actions say."""
    rows = frame(spark, [("claude", "no json"), ("other", '{"a":"b"}'), ("claude", '{"messages":[{"content":"plain"}]}')])
    got = P.scrub(rows, unknown_action="warn_allow").orderBy("request_id").collect()
    assert [r.block for r in got] == [True, False, False] and got[0].masked is None


def test_detections_over_tables_of_their_own(spark):
    """A column that belongs to one table leaves nothing behind for others of its name."""
    a, b = (spark.createDataFrame([(f"to {MAIL}",)], "body string") for _ in range(2))
    one = a.select(F.size(P.detect(a["body"])).alias("n"))
    two = b.select(F.size(P.detect(F.col("body"))).alias("n"))
    again = a.select(F.size(P.detect(F.col("body"))).alias("n"))
    assert [x.first().n for x in (one, two, again)] == [1, 1, 1]


def test_responses(spark):
    known = F.create_map(F.lit("EMAIL_1"), F.lit(MAIL), F.lit("EMAIL_12"), F.lit("b"))
    bodies = [("claude", '{"content":[{"type":"text","text":"[EMAIL_12] [EMAIL_1]"}]}'), ("claude", "no json [EMAIL_1]"), (None, '{"a":["[EMAIL_1]"]}'), ("openai", '{"choices":[{"message":{"content":[{"type":"text","text":"[EMAIL_1]"}]}}]}'), ("gemini", "[]"), ("claude", None)]
    rows = frame(spark, bodies)
    got = [r.r for r in rows.select("request_id", P.process_response(F.col("provider"), F.col("payload"), known).alias("r")).orderBy("request_id").collect()]
    assert [g.substitution_count for g in got] == [2, 0, 1, 1, 0, 0]
    assert json.loads(got[0].agent_body)["content"][0]["text"] == f"b {MAIL}" and got[0].terminal_text == "[EMAIL_12] [EMAIL_1]" and got[1].agent_body == bodies[1][1]
    shown = rows.where("request_id = 0").select(P.process_response(F.col("provider"), F.col("payload"), known, terminal_restore=True).alias("r")).first().r
    assert shown.terminal_text == f"b {MAIL}"


def test_unknown_provider_of_a_diff(spark):
    with pytest.raises(ValueError):
        P.diff_request(frame(spark, ODD), "other")


STREAM = "data: {}\n\n: note\r\n\r\n" + "".join(S.event_text("content_block_delta", {"type": "content_block_delta", "delta": {"type": "text_delta", "text": t}}) for t in ("Hi é🙂 [EMA", "IL_1", "] and [", "EMAIL_2] [no")) + "data: [DONE]\n\n"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_events_cut_anywhere(size):
    raw, known = STREAM.encode(), {"EMAIL_1": MAIL, "EMAIL_2": "x"}
    parser, one, events, out = S.EventParser(), None, [], ""
    one = S.EventRehydrator(known, "claude")
    for k in range(0, len(raw), size):
        events += parser.feed(raw[k : k + size])
        out += one.feed(raw[k : k + size])
        one = S.EventRehydrator(known, "claude", one.state)  # as between micro-batches
    events += parser.flush()
    out += one.flush()
    assert "".join(events) == STREAM
    texts = [json.loads(d)["delta"]["text"] for _, d in map(S.event_fields, S.EventParser().feed(out.encode())) if "delta" in d]
    assert "".join(texts) == f"Hi é🙂 {MAIL} and x [no" and out.index("[DONE]") > 0


def test_limit_of_the_buffer():
    with pytest.raises(ValueError):
        S.cut("x", 127)


def test_chunks_wait_for_their_turn():
    """Chunks in any order, one batch each, some twice: what comes out is in order, and each once."""
    import itertools

    rows = [[k, f"c{k}", k == 3] for k in range(4)]
    for order in itertools.permutations([*rows, rows[1]]):
        waiting, at, out = [], 0, []
        for row in order:
            ready, waiting, at = S._in_turn([*waiting, row], at)
            out += ready
        assert out == rows and waiting == [] and at == 4


@pytest.mark.parametrize("kind", ["text", "events"])
def test_late_chunks_wait_over_micro_batches(spark, tmp_path, kind):
    pieces = ["a [EMA", "IL_1] b", " c [EM", "AIL_1] end"]
    schema = "stream_id string, provider string, seq long, chunk string, last boolean"
    for n, k in enumerate([0, 2, 3, 1]):
        body = pieces[k] if kind == "text" else S.event_text(None, {"choices": [{"delta": {"content": pieces[k]}}]})
        spark.createDataFrame([("s", "openai", k, body, k == 3)], schema).coalesce(1).write.json(f"{tmp_path}/in{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    out = S.restored_stream(source.drop("provider"), {"EMAIL_1": MAIL}) if kind == "text" else S.rehydrated_events(source.withColumn("chunk", F.encode("chunk", "UTF-8")), {"EMAIL_1": MAIL})
    name = f"late_{kind}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    for _ in range(300):
        if spark.table(name).count() == 4:
            break
        time.sleep(0.2)
    query.stop()
    rows = [tuple(r) for r in spark.table(name).collect()]
    assert [r[1] for r in rows] == [0, 1, 2, 3]
    text = "".join(r[2] for r in rows)
    if kind == "events":
        text = "".join(json.loads(d)["choices"][0]["delta"]["content"] for _, d in map(S.event_fields, S.EventParser().feed(text.encode())))
    assert text == f"a {MAIL} b c {MAIL} end"


@pytest.mark.parametrize("kind", ["text", "events"])
def test_stateful_streams(spark, tmp_path, kind):
    """The same chunks in three micro-batches; a stream that has ended keeps no state."""
    known = {"EMAIL_1": MAIL}
    pieces = ["a [EMA", "IL_1] b", " c [EM"]
    for k, text in enumerate(pieces):
        body = text if kind == "text" else S.event_text(None, {"choices": [{"delta": {"content": text}}]})
        rows = [(f"s{n}", "openai", k, body, k == 2 and n == 0) for n in range(2)]
        spark.createDataFrame(rows, "stream_id string, provider string, seq long, chunk string, last boolean").coalesce(1).write.mode("append").json(f"{tmp_path}/in{k}")
    schema = "stream_id string, provider string, seq long, chunk string, last boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    out = S.restored_stream(source.drop("provider"), known) if kind == "text" else S.rehydrated_events(source.withColumn("chunk", F.encode("chunk", "UTF-8")), known)
    name = f"out_{kind}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    for _ in range(300):  # with a timeout, a query never has nothing more to do
        if spark.table(name).count() == 6 and query.lastProgress and query.lastProgress["numInputRows"] == 0:
            break
        time.sleep(0.2)
    query.stop()
    rows = pd.DataFrame([r.asDict() for r in spark.table(name).collect()]).sort_values(["stream_id", "seq"])
    text = {s: "".join(g.iloc[:, 2]) for s, g in rows.groupby("stream_id")}
    if kind == "events":
        text = {s: "".join(json.loads(d)["choices"][0]["delta"]["content"] for _, d in map(S.event_fields, S.EventParser().feed(t.encode()))) for s, t in text.items()}
    assert text == {"s0": f"a {MAIL} b c [EM", "s1": f"a {MAIL} b c "}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
