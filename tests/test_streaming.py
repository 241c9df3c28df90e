import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from brindle.operators import incremental
from brindle.streaming import limits


def test_failures_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = limits.failures_by_minute(stream, "user_id", "ts", F.col("event_type") == "error")
    q = made.writeStream.format("memory").queryName("failures").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    # a minute that slides by ten seconds holds each event six times
    assert spark.table("failures").agg(F.sum("failures")).first()[0] == 6 * events.where("event_type = 'error'").count()


def test_queue_on_a_stream(spark, tmp_path):
    """Rows that aren't due, or fail, come again; a new change replaces what waits; nothing is lost."""
    schema = "id long, enqueued_at string, attempts long, claimed_at timestamp, processed_at timestamp, run_after timestamp"
    start = datetime(2024, 1, 1, tzinfo=UTC)
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    row = lambda i, attempts=0, wait=0, stamp="a": (i, stamp, attempts, None, None, start + timedelta(seconds=wait))
    seen = []

    def run(at, failing=()):
        def work(df, number):
            ids = [r.id for r in df.collect()]
            seen.append(ids)
            return spark.createDataFrame([(i, i in failing) for i in ids], "id long, failed boolean")

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = limits.run_queue(stream, work, str(tmp_path / "c"), str(tmp_path / "s"), clock=lambda: start + timedelta(seconds=at))
        q.awaitTermination()

    put("one", [row(1), row(2, wait=100), row(3, attempts=8), row(4)])
    run(10, failing={4})
    put("two", [row(5, stamp="b"), row(1, stamp="b")])
    run(11)  # 4 waits two seconds, 2 isn't due
    put("three", [row(6, stamp="c")])
    run(120)
    assert seen == [[1, 4], [1, 5], [2, 4, 6]]
    left = spark.read.parquet(str(tmp_path / "s" / "2")).collect()
    assert [(r.id, r.attempts) for r in left] == [(3, 8)]


def test_latest_changes_on_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "a"), (1, "2024-01-01 00:00:30", "b"), (2, "2024-01-01 00:00:10", "c"), (1, "2024-01-01 00:00:20", "x"), (9, "2024-01-02 00:00:00", "end")]
    df = spark.createDataFrame(rows, "id long, t string, v string").selectExpr("id", "cast(t as timestamp) as ts", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.latest_changes(stream, "id", "ts").writeStream.format("memory").queryName("latest").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {(r.id, r.v) for r in spark.table("latest").collect()} == {(1, "b"), (2, "c")}


def test_batches_do_not_depend_on_partitions(spark):
    """Against a plain fold, however rows are cut: long groups over many slices, rows over the limit, nulls."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0.0, 1.0, 3.0, 9.0, 30.0, None])) for i in range(3000)]
    want, state = {}, {}
    for g, i, w in sorted(rows, key=lambda r: r[1]):
        total, count = state.get(g, (0, 0))
        total, count = (total + (w or 0), count) if count and total + (w or 0) <= 25 else (w or 0, count + 1)
        state[g], want[i] = (total, count), count
    df = spark.createDataFrame(rows, "g string, i long, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "2", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.i: r.batch for r in incremental.greedy_batches(df, "g", "i", "w", 25).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert incremental.greedy_batches(df.limit(0), "g", "i", "w", 25).count() == 0


def test_failures_before_each_event(spark):
    """One user of most events, ties and bounds, against a double loop."""
    rng = random.Random(6)
    rows = [(i, 1 if rng.random() < 0.7 else None if rng.random() < 0.3 else 2, rng.randrange(300), rng.random() < 0.4) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, u long, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.prior_failures for r in incremental.trailing_failures(df, "u", "ts", F.col("bad"), 60).collect()}
    assert got == {i: sum(v == u and bad and s - 60 < t < s for _, v, t, bad in rows) for i, u, s, _ in rows}
