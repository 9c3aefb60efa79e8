"""Compact state, change feed, debounced saves and timers: streams against the table at rest."""

import random
from datetime import datetime, timedelta

import pytest
from ledgerloom.operators.resolution import fold
from ledgerloom.streaming import feeds, timers
from ledgerloom.streaming.keyed import KeyedState, latest
from ledgerloom.streaming.sessions import debounced
from pyspark.sql import functions as F

SCHEMA = "k string, ord int, v string, gone boolean"


@pytest.fixture
def state(spark, tmp_path):
    frame = spark.createDataFrame([], SCHEMA)
    return KeyedState(spark, str(tmp_path / "state"), frame.schema, ["k"], latest(frame.columns, ["k"], "ord"), removed="gone", buckets=8)


def shown(frame):
    return sorted(tuple(r)[:3] for r in frame.collect())


def batch(spark, *rows):
    return spark.createDataFrame([(k, o, v, v is None) for k, o, v in rows], SCHEMA)


def test_state_follows_batches(spark, state):
    assert shown(state.rows()) == [] and shown(state.changes()) == []
    first = state.merge(batch(spark, ("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z"), (None, 1, "n")), 0)
    assert shown(state.rows().where("k is not null")) == [("a", 2, "z"), ("b", 1, "y")] and state.rows().count() == 3
    assert {r.k: r.change for r in state.changes(0).collect()} == {"a": "inserted", "b": "inserted", None: "inserted"}
    # an older row changes nothing, a newer one does, a delete is seen and an old row does not undo it
    touched = state.merge(batch(spark, ("a", 1, "old"), ("b", 5, None), ("c", 1, "w")), 1)
    assert set(touched) < set(range(8)) and len(first) <= 3 and len(touched) <= 3
    assert shown(state.rows().where("k is not null")) == [("a", 2, "z"), ("c", 1, "w")]
    assert {r.k: r.change for r in state.changes(1).collect()} == {"b": "deleted", "c": "inserted"}
    state.merge(batch(spark, ("b", 3, "late"), ("a", 9, "new")), 2)
    assert {r.k: r.change for r in state.changes(2).collect()} == {"a": "updated"}
    state.merge(batch(spark, ("b", 8, "back")), 3)
    assert {r.k: r.change for r in state.changes(3).collect()} == {"b": "inserted"}
    assert state.merge(batch(spark), 4) == [] and state.pointers() == [3, 4]


def test_a_batch_can_be_repeated(spark, state, monkeypatch):
    state.merge(batch(spark, ("a", 1, "x")), 0)
    monkeypatch.setattr(state, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        state.merge(batch(spark, ("a", 2, "y"), ("b", 1, "z")), 1)
    assert shown(state.rows()) == [("a", 1, "x")]  # nothing of it is seen
    monkeypatch.undo()
    state.merge(batch(spark, ("a", 2, "y"), ("b", 1, "z")), 1)
    assert shown(state.rows()) == [("a", 2, "y"), ("b", 1, "z")]
    assert state.merge(batch(spark, ("a", 7, "no")), 1) == []  # merged already
    assert shown(state.rows()) == [("a", 2, "y"), ("b", 1, "z")]


def test_state_grows_with_keys_only(spark, state, tmp_path):
    def kept():
        return sum(p.stat().st_size for p in (tmp_path / "state" / "rows").rglob("part-*.parquet"))

    sizes = []
    for n in range(6):
        state.merge(spark.range(200).selectExpr("cast(id as string) as k", f"{n} as ord", f"'v{n}' as v", "false as gone"), n)
        sizes.append(kept())
    assert max(sizes[2:]) <= sizes[1] * 1.1 and state.rows().count() == 200


def test_any_split_gives_the_same_fold(spark, tmp_path):
    draw = random.Random(1)
    rows = [(f"k{draw.randrange(5)}", i, draw.choice([None, "", "$0", "a", "b", "c"])) for i in range(80)]
    frame = spark.createDataFrame(rows, "k string, ord int, v string")
    want = sorted(map(tuple, frame.groupBy("k").agg(fold("v"), F.count("*")).collect()))
    for trial in range(2):
        draw.shuffle(rows)
        cuts = sorted(draw.sample(range(80), 3))
        state = feeds.enrichment_state(spark, str(tmp_path / f"fold{trial}"), {"k": "string"}, ["v"], {"v": "string"}, "int", buckets=4)
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 80], strict=True)):
            state.merge(feeds.arrival_states(spark.createDataFrame(rows[a:b], "k string, ord int, v string"), ["k"], ["v"], "ord"), n)
        assert sorted(map(tuple, feeds.enriched(state.rows(), ["k"], ["v"]).select("k", "v", "arrivals").collect())) == want


def test_deletes_in_a_stream(spark, tmp_path):
    landing = str(tmp_path / "in")
    for n in range(3):
        batch(spark, ("a", n, f"v{n}"), (f"only{n}", n, "x"), ("gone", n, None if n == 2 else "y")).coalesce(1).write.mode("append").parquet(landing)
    frame = spark.read.parquet(landing)
    state = KeyedState(spark, str(tmp_path / "state"), frame.schema, ["k"], latest(frame.columns, ["k"], "ord"), removed="gone", buckets=4)
    feeds.drain(feeds.arrivals(spark, landing, frame.schema, files=1), state.merge, str(tmp_path))
    assert shown(state.rows()) == [("a", 2, "v2"), ("only0", 0, "x"), ("only1", 1, "x"), ("only2", 2, "x")]
    batch(spark, ("a", 9, "last")).coalesce(1).write.mode("append").parquet(landing)
    feeds.poll(feeds.arrivals(spark, landing, frame.schema), state, str(tmp_path), every="1 second", seconds=8)  # goes on where it stopped
    assert ("a", 9, "last") in shown(state.rows())


def log_of(draw, n, start=datetime(2024, 1, 1)):
    return [(f"j{draw.randrange(12)}", i, draw.choice(["pending", "processing", "processing", "completed", "failed", "odd"]), start + timedelta(hours=draw.randrange(24 * 40))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_timers_by_replay_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = log_of(draw, 150)
    rows.sort(key=lambda r: r[3] + timedelta(hours=draw.randrange(48)))  # late by less than two days
    schema, landing = "id string, seq long, status string, ts timestamp", str(tmp_path / "in")
    now = datetime(2024, 3, 1)
    for n in range(0, 150, 30):
        spark.createDataFrame(rows[n : n + 30], schema).coalesce(1).write.mode("append").parquet(landing)
    spark.createDataFrame([("clock", 999, "odd", now + timedelta(days=3))], schema).coalesce(1).write.mode("append").parquet(landing)
    frame = spark.read.parquet(landing)
    stream = timers.stream_outcomes(feeds.arrivals(spark, landing, frame.schema, files=1), "3 days", days=7)
    got = []
    # files of one second have no order of their own; the watermark is wide enough for any
    stream.writeStream.foreachBatch(lambda part, _: got.extend(map(tuple, part.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, timers.outcomes(frame, str(now), days=7).collect()), key=repr)
    assert sorted((r for r in got if r[0] != "clock"), key=repr) == want
    assert {r[4] for r in want} == {"accepted", "rejected", "escalated"}


def test_timers_at_the_edge(spark):
    day, t0 = timedelta(days=1), datetime(2024, 1, 1)
    log = [("a", 1, "pending", t0), ("a", 2, "processing", t0 + day), ("a", 3, "completed", t0 + 7 * day), ("b", 4, "pending", t0), ("b", 5, "processing", t0 + 9 * day), ("b", 6, "failed", t0 + 9 * day), ("c", 7, "processing", t0)]
    frame = spark.createDataFrame(log, "id string, seq long, status string, ts timestamp")
    got = {(r.id, r.seq): r.outcome for r in timers.outcomes(frame, "2024-02-01", days=7).collect()}
    assert got == {("a", 1): "accepted", ("a", 2): "accepted", ("a", 3): "rejected", ("a", None): "escalated", ("b", 4): "accepted", ("b", 5): "accepted", ("b", 6): "rejected", ("b", None): "escalated", ("c", 7): "rejected"}
    assert not [r for r in timers.outcomes(frame, "2024-01-07", days=7).collect() if r.outcome == "escalated"]


def test_debounced_stream_is_the_batch(spark, tmp_path):
    draw, t0 = random.Random(5), datetime(2024, 1, 1)
    rows = sorted(((draw.randrange(6), i, f"v{i}", t0 + timedelta(seconds=draw.randrange(4000))) for i in range(200)), key=lambda r: r[3])
    schema, landing = "u int, seq int, v string, ts timestamp", str(tmp_path / "in")
    for n in range(0, 200, 50):
        spark.createDataFrame(rows[n : n + 50], schema).coalesce(1).write.mode("append").parquet(landing)
    spark.createDataFrame([(99, 999, "clock", t0 + timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(landing)
    frame, got = spark.read.parquet(landing), []
    stream = debounced(feeds.arrivals(spark, landing, frame.schema, files=1), "u", "ts", "seq", ["v", "seq"], "60 seconds", late="2 hours")
    stream.writeStream.outputMode("append").foreachBatch(lambda part, _: got.extend(map(tuple, part.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = sorted(r for r in map(tuple, debounced(frame, "u", "ts", "seq", ["v", "seq"], "60 seconds").collect()) if r[0] != 99)
    assert sorted(got) == want and 6 < len(want) < 200 and sum(r[1] for r in want) == 200
