"""Limits, retention and queues on streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.incremental import after_batch, claim, latest_by_key
from brindle.sources.tables import discard, exists, materialize, remove


def failures_by_minute(events: DataFrame, user: str, ts: str, failed: Column, lateness: str = "10 minutes") -> DataFrame:
    """(user, window, failures): failures in minutes that slide by ten seconds; later events than lateness are left out."""
    return (
        events.where(failed)
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 minute", "10 seconds"), user)
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def latest_changes(changes: DataFrame, key: str, ts: str, every: str = "1 minute", lateness: str = "1 hour") -> DataFrame:
    """The latest change of each key in each stretch of time: what is queued again meanwhile replaces what was waiting."""
    rest = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(ts)).alias("_r")
    kept = changes.withWatermark(ts, lateness).groupBy(F.window(ts, every), key).agg(last)
    return kept.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in changes.columns])


def run_queue(
    changes: DataFrame,
    work: Callable[[DataFrame, int], DataFrame | None],
    checkpoint: str,
    state: str,
    every: str | None = None,
    lease_seconds: int = 60,
    most_attempts: int = 8,
    limit: int | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(UTC),
) -> StreamingQuery:
    """Give work all due rows of the queue at each micro-batch, oldest first, at most limit.

    changes has id, enqueued_at and the columns of incremental.claim. The queue is a table in the
    folder state, which driver and executors share: a version for each micro-batch holds every row
    that isn't processed yet, so that rows that aren't due, are leased, or failed come
    again. A new change of an id replaces what waits. work gives (id, failed) for the rows it
    tried, or None if all are done. A micro-batch that fails is given again with the same number
    and the same queue, so work should be idempotent by that number. Without every, what is there
    is worked off and the query ends; later runs go on with the same folders. With every, a beat
    of the clock wakes the queue also when nothing new comes.
    """
    spark = changes.sparkSession
    columns = changes.columns

    def lot(df: DataFrame, number: int) -> None:
        now = F.lit(clock())
        fresh = df.where("id is not null").select(*columns)
        known = exists(spark, f"{state}/{number - 1}")
        queue = fresh.withColumn("_new", F.lit(1))
        if known:
            queue = spark.read.parquet(f"{state}/{number - 1}").withColumn("_new", F.lit(0)).unionByName(queue)
        queue = materialize(latest_by_key(queue, "id", ["_new", "enqueued_at"]).select(*columns), "queue")
        due = claim(queue, ["enqueued_at", "id"], now, lease_seconds, most_attempts, limit)
        done = work(due, number)
        results = due.select("id", F.lit(False).alias("failed")) if done is None else done
        after_batch(queue, results, "id", now, most_attempts).where("processed_at is null").write.mode("overwrite").parquet(f"{state}/{number}")
        discard(queue)
        remove(spark, f"{state}/{number - 2}")

    if every:
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        changes = changes.unionByName(beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields]))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(lot).option("checkpointLocation", checkpoint).trigger(**trigger).start()
