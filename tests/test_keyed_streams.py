"""Exact trailing counts on a stream against the batch form, over a restart, with state of live keys only."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.operators import incremental
from brindle.streaming import keyed


@pytest.fixture
def store(spark):
    before = spark.conf.get(keyed.STORE[0])
    spark.conf.set(*keyed.STORE)
    yield
    spark.conf.set(keyed.STORE[0], before)


def test_trailing_failures_over_a_restart(spark, store, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(1200) + rng.random(), rng.random() < 0.4) for i in range(600)]
    rows.sort(key=lambda r: r[2] + rng.uniform(-40, 40))  # out of order, within the lateness
    end = [(10_000, 9, 100_000.0, False)]  # carries the watermark past all others
    df = lambda x: spark.createDataFrame(x, "id long, u long, s double, bad boolean").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    want = {r.id: r.prior_failures for r in incremental.trailing_failures(df(rows), "u", "ts", F.col("bad"), 60).collect()}
    schema = df(rows[:1]).schema
    got, states = [], []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = keyed.trailing_failures(stream, "u", "id", "ts", F.col("bad"), 60, "2 minutes")
        q = made.writeStream.foreachBatch(lambda x, _: got.extend(x.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
        states.append([s.numRowsTotal for p in q.recentProgress for s in p.stateOperators])

    for part in (rows[:300], rows[300:450]):
        df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    first = len(got)
    assert 0 < first < 450
    df(rows[450:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df(end).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on from the checkpoint
    df([(10_001, 9, 300_000.0, False)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    told = {r.id: r.prior_failures for r in got if r.id < 10_000}
    assert len(got) == len({r.id for r in got}) and told == want
    assert max(want.values()) > 3
    assert states[-1][-1] <= 2 < max(s for run_ in states for s in run_)  # users of whom nothing is left hold nothing


CHANGE = "id long, enqueued_at timestamp, run_after timestamp, payload string, at timestamp"
RESULT = "id long, enqueued_at timestamp, attempt int, failed boolean, at timestamp"


def plain_queue(steps, lease, most):
    """The queue as a plain loop: steps of (changes, results), each at the time that the steps before it reached; the rows that come out of each."""
    held, out, now = {}, [], 0
    for changes, results in steps:
        told = []

        def settle(i, told=told, now=now):
            h = held.get(i)
            if h and h["due"] <= now:
                if h["n"] >= most:
                    told.append((i, h["v"], h["n"], "parked", h["p"]))
                    del held[i]
                else:
                    held[i] = {**h, "n": h["n"] + 1, "leased": True, "due": now + lease}
                    told.append((i, h["v"], h["n"] + 1, "claimed", h["p"]))

        ids = {c[0] for c in changes} | {r[0] for r in results}
        for i in ids:
            was = held.get(i, {}).get("v", float("-inf"))
            h = held.get(i)
            ends = {failed for k, v, n, failed, _ in results if h and h["leased"] and (k, v, n) == (i, h["v"], h["n"])}
            if False in ends:
                del held[i]
            elif ends:
                held[i] = {**h, "leased": False, "due": now + (0 if h["n"] >= most else min(2 ** min(h["n"], 6), 3600))}
            newest = max(((v, due or 0, p or "", p) for k, v, due, p, _ in changes if k == i), default=None)
            if newest and newest[0] > was:
                held[i] = {"v": newest[0], "n": 0, "leased": False, "due": newest[1], "p": newest[3]}
            settle(i)
        for i in sorted(held):
            if held[i]["due"] <= now:
                settle(i)
        out.append(told)
        now = max([now, *(c[-1] for c in changes), *(r[-1] for r in results)])
    return out


def test_queue_with_timers(spark, store, tmp_path):
    """Against the plain loop, over a restart: leases that end, backoff, parked rows, replaced ones, results of lost leases, redelivery."""
    rng, lease, most = random.Random(8), 30, 3
    steps, given = [], []
    for n in range(14):
        at, changes, results = 20 * (n + 1), [], []
        for _ in range(rng.randrange(1, 5) if n < 8 else 0):
            i = rng.randrange(9)
            changes.append((i, at + rng.randrange(-30, 3), rng.choice([at + 1, at - 50, at + 45, None]), rng.choice([f"p{n}", None]), at))
        for i, v, k, status, _ in rng.sample(given, min(len(given), 4)):
            if status == "claimed":
                results.append((i, v, rng.choice([k, k, k, 1]), rng.random() < 0.5, at))
        changes.append((99, at, 10**6, "clock", at))  # carries the watermark on; never due
        steps.append((changes, results))
        given = [r for told in plain_queue(steps, lease, most)[-3:] for r in told]
        if n in (5, 13):
            steps.append(([], []))  # a run ends with what its last watermark lets out
    want = plain_queue(steps, lease, most)
    seconds = lambda df: df.withColumns({c: F.timestamp_seconds(c) for c in ("enqueued_at", "at", "run_after") if c in df.columns})
    got, states = [], []

    def run():
        read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind))
        made = keyed.queue(read("changes", CHANGE), read("results", RESULT), lease, most, clock="event")
        q = made.writeStream.foreachBatch(lambda x, _: got.append([tuple(r) for r in x.withColumn("enqueued_at", F.unix_seconds("enqueued_at")).collect()]))
        q = q.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
        states.extend(max(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress)

    for changes, results in steps:
        if changes:
            for kind, rows, schema in (("changes", changes, CHANGE), ("results", results, RESULT)):
                seconds(spark.createDataFrame(rows, schema.replace("timestamp", "long"))).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        else:
            run()  # the second goes on from the checkpoint
    in_order = lambda x: sorted(x, key=str)
    assert [in_order(x) for x in got if x] == [in_order(x) for x in want if x]
    rows = [r for x in want for r in x]
    assert {r[3] for r in rows} == {"claimed", "parked"} and {r[2] for r in rows} == {1, 2, 3}
    assert len(rows) > 20 and states[-1] < max(states)  # what is done or parked holds nothing


def test_queue_by_the_machine_clock(spark, store, tmp_path):
    """A lease of a second ends by itself, without any new input, until the row is given up; a done row isn't seen again."""
    schema, told = CHANGE.rsplit(",", 1)[0], RESULT.rsplit(",", 1)[0]
    put = lambda kind, rows, s: spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
    put("changes", [(1, None, None, "a"), (2, None, None, None), (None, None, None, "x")], schema)
    put("results", [], told)
    got = []

    def take(df, _):
        rows = [tuple(r) for r in df.collect()]
        got.extend(rows)
        done = [(r[0], r[1], r[2], False) for r in rows if r[0] == 2]
        if done:
            put("results", done, told)

    read = lambda kind, s: spark.readStream.schema(s).parquet(str(tmp_path / kind))
    made = keyed.queue(read("changes", schema), read("results", told), 6, 2)
    q = made.writeStream.foreachBatch(take).trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 90
        while time.time() < end and not any(r[3] == "parked" for r in got) and q.isActive:
            time.sleep(1)
    finally:
        q.stop()
    assert [r[2:] for r in got if r[0] == 1] == [(1, "claimed", "a"), (2, "claimed", "a"), (2, "parked", "a")]
    assert [r[1:] for r in got if r[0] == 2] == [(None, 1, "claimed", None)]
