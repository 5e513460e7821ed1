"""Several micro-batches number as one table does; resets, times to live, and what state holds."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators import tokens as K
from maskwright.streaming import sessions as S

KEY = b"a key of 32 bytes or more for tests only"


def one_by_one(rows):
    """(session, order, original, category, blocked, reset) to tokens, by hand."""
    known, counts, out = {}, {}, []
    for s, o, v, c, b, reset in sorted(rows, key=lambda r: (r[1], not r[5])):
        if reset:
            known = {k: t for k, t in known.items() if k[0] != s}
            counts = {k: n for k, n in counts.items() if k[0] != s}
        if v and c:
            fresh = (s, v) not in known
            if fresh:
                counts[s, c] = counts.get((s, c), 0) + 1
                known[s, v] = f"{c}_{counts[s, c]}" + ("_BLOCKED" if b else "")
            out.append((s, o, v, c, known[s, v], fresh))
    return sorted(out, key=str)


def sightings(n=240):
    rng = random.Random(3)
    out = []
    for k in range(n):
        s = rng.choice(["a", "b", "c", None])
        out.append((s, k, rng.choice(["", None, *(f"v{x}" for x in range(12))]), rng.choice(["EMAIL", "CARD", "", "PHONE"]), rng.choice([True, False, None]), rng.random() < 0.03))
    return out


def until(query, done, seconds=60):
    """A query with a clock never has nothing more to do: it is stopped when it is done."""
    try:
        end = time.time() + seconds
        while time.time() < end and query.isActive and not done():
            time.sleep(0.2)
    finally:
        query.stop()
    assert query.exception() is None and done()


def run(spark, tmp_path, batches, name, rows, **options):
    """rows: how many come out."""
    for k, some in enumerate(batches):
        spark.createDataFrame(some, S.SIGHTINGS).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k:03d}")
    source = spark.readStream.schema(S.SIGHTINGS).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    query = S.session_stream(source, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    until(query, lambda: spark.table(name).count() >= rows)
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def test_micro_batches_number_as_one_table(spark, tmp_path):
    rows = sightings()
    got = run(spark, tmp_path, [rows[a : a + 60] for a in range(0, 240, 60)], "sessions_four", len(one_by_one(rows)), key=KEY)
    assert got == one_by_one(rows)
    whole = S.session_stream(spark.createDataFrame(rows, S.SIGHTINGS).repartition(3)).collect()
    assert sorted((tuple(r) for r in whole), key=str) == got
    # Without resets, that is what the batch operator gives.
    plain = [r for r in rows if not r[5] and r[0]]
    found = spark.createDataFrame(plain, S.SIGHTINGS).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    batch = {(r.session, r.original): r.token for r in K.number_values(found, "session", ["order"]).collect()}
    assert batch == {(r[0], r[2]): r[4] for r in one_by_one(plain)}


def test_reset_starts_at_one(spark, tmp_path):
    rows = [[("s", 1, "x", "EMAIL", False, False), ("t", 1, "x", "EMAIL", True, False)], [("s", 2, None, None, None, True)], [("s", 3, "y", "EMAIL", False, False), ("s", 4, "x", "EMAIL", False, False), ("t", 4, "z", "EMAIL", False, False)]]
    got = run(spark, tmp_path, rows, "sessions_reset", 5)
    assert [(r[0], r[2], r[4]) for r in got] == [("s", "x", "EMAIL_1"), ("s", "y", "EMAIL_1"), ("s", "x", "EMAIL_2"), ("t", "x", "EMAIL_1_BLOCKED"), ("t", "z", "EMAIL_2")]


def test_time_to_live(spark, tmp_path):
    """What wasn't used for that long is forgotten; another run of the same query goes on from its checkpoint."""
    for k in range(2):
        spark.createDataFrame([("s", k, f"v{k}", "EMAIL", False, False)], S.SIGHTINGS).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(S.SIGHTINGS).json(f"{tmp_path}/in/*")
        out = S.session_stream(source, time_to_live_ms=3_600_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        until(out, lambda k=k: os.path.exists(f"{tmp_path}/out/_spark_metadata/{k}") and spark.read.schema(S.TOKENS).parquet(f"{tmp_path}/out").count() == k + 1)
    assert sorted(r.token for r in spark.read.schema(S.TOKENS).parquet(f"{tmp_path}/out").collect()) == ["EMAIL_1", "EMAIL_2"]
    short = run(spark, tmp_path / "short", [[("s", 1, "x", "EMAIL", False, False)], [("s", 2, "y", "EMAIL", False, False)]], "sessions_short", 2, time_to_live_ms=1)
    assert [r[4] for r in short] == ["EMAIL_1", "EMAIL_1"]


@pytest.mark.parametrize("key", [None, KEY])
def test_state_holds_names(key):
    p = S.SessionTokens(key)
    assert (p._name("ann@example.org") == "ann@example.org") == (key is None)


class _List:
    """A list state that counts the calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows += rows

    def clear(self):
        self.calls += 1
        self.rows = []


def test_calls_of_the_state_do_not_follow_the_number_of_names():
    state = _List()
    for batch in range(2):
        held = S._Listed(state)
        for k in range(5_000):
            if held.get(f"v{k}") is None:
                held.put(f"v{k}", f"EMAIL_{k + 1}")
        assert held.get("v4999") == "EMAIL_5000"
        held.flush(False)
    assert len(state.rows) == 5_000 and state.calls == 3
    held.clear()
    held.put("v9", "EMAIL_1")
    held.flush(False)
    assert state.rows == [("v9", "EMAIL_1")]
