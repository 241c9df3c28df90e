"""Change feeds, queues and limits, in batch form; brindle.streaming runs them on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.functions.numbers import backoff
from brindle.sources.tables import materialize


def change_feed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], wanted: Column) -> DataFrame:
    """(key, change): rows that are new, or differ in any of the columns, and are wanted."""
    a = old.select(key, F.struct(*columns).alias("_old"))
    both = new.where(wanted).select(key, F.struct(*columns).alias("_new")).join(a, key, "left")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, F.when(F.col("_old").isNull(), "insert").otherwise("update").alias("change"))


def trailing_failures(events: DataFrame, user: str, ts: str, failed: Column, seconds: int = 60) -> DataFrame:
    """events with prior_failures: that user's failures in the seconds strictly before each.

    A user's events are dealt out by bands of that length. Failures, summed up by moment
    first, go to their own band and the next one, so that each band has all that it needs and a user of
    very many events is many groups.
    """
    width = seconds * 1_000_000
    moment, band = F.unix_micros(F.col(ts).cast("timestamp")), F.floor(F.col("_moment") / width)
    rows = events.withColumns({"_moment": moment, "_own": F.lit(True)}).withColumn("_band", band)
    fails = events.where(failed).select(F.col(user), moment.alias("_moment")).groupBy(user, "_moment").agg(F.count(F.lit(1)).alias("_n"))
    fails = fails.select(user, "_moment", "_n", F.explode(F.array(band, band + 1)).alias("_band"))
    span = Window.partitionBy(user, "_band").orderBy("_moment").rangeBetween(-width + 1, -1)
    both = rows.unionByName(fails, allowMissingColumns=True).withColumn("prior_failures", F.coalesce(F.sum("_n").over(span), F.lit(0)))
    return both.where("_own").select(*events.columns, "prior_failures")


def claim(queue: DataFrame, order: Sequence[str], now: Column, lease_seconds: int, most_attempts: int, limit: int | None = None) -> DataFrame:
    """Rows that are due (not done, not under a live lease, and with attempts left), oldest first; all of them, or a worker's batch."""
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds)))
    due = F.col("processed_at").isNull() & free & (F.col("attempts") < most_attempts) & (F.col("run_after") <= now)
    found = queue.where(due).orderBy(*order)
    return found if limit is None else found.limit(limit)


def after_attempt(attempts: Column, failed: Column, now: Column) -> Column:
    """When a row may run again: after its backoff if it failed, else never."""
    return F.when(failed, now + F.make_dt_interval(secs=backoff(attempts + 1)))


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def _from_each_row(weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """If a batch starts at a row: the weight of the last batch when the rows end, and the batches started by then."""
    n = len(weights)
    total = np.r_[0.0, np.cumsum(weights)]
    after = np.maximum(np.searchsorted(total, total[:-1] + limit, side="right") - 1, np.arange(n) + 1)
    left, started = np.zeros(n), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            left[i], started[i] = left[after[i]], started[after[i]] + 1
        else:
            left[i] = total[n] - total[i]
    return left, started


def _entries(ends: list, limit: float) -> list[tuple[int, float, int]]:
    """(slice, weight of the open batch, batches so far) with which each slice's first group begins; 0 batches if it is new."""
    out, group, weight, count = [], None, 0.0, 0
    for r in sorted(ends, key=lambda r: r.slice):
        goes_on = count > 0 and r.first == group
        entry = (weight, count) if goes_on else (0.0, 0)
        out.append((r.slice, *entry))
        if not r.single:
            group, weight, count = r.last, r.left, r.started
        else:
            at = 0 if not goes_on else next((i for i, upto in enumerate(r.upto) if weight + upto > limit), -1)
            group = r.last
            weight, count = (entry[0] + r.total, entry[1]) if at < 0 else (r.lefts[at], entry[1] + r.starts[at])
    return out


def greedy_batches(df: DataFrame, group: str, order: str, weight: str, limit: int) -> DataFrame:
    """df with batch (from 1): rows of a group in order, a new batch where the next row would bring its weight over limit.

    Rows are sorted by range into slices, so a large group takes several tasks. Each slice tells
    with which weight it would end for each row that its first batch may start at; those are rows of
    one batch at most. The driver goes from slice to slice with that, and then each slice
    numbers its own rows; results don't depend on how rows are cut into slices. A row over the
    limit is a batch of its own. Null weights count as 0. order should be unique in a group.
    """
    columns = df.columns
    tagged = StructType([*df.schema.fields, StructField("_slice", LongType()), StructField("_place", LongType())])

    def tag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(_slice=task, _place=np.arange(seen, seen + len(frame)))
            seen += len(frame)

    rows = materialize(df.repartitionByRange(group, order).sortWithinPartitions(group, order).mapInPandas(tag, tagged), "batches")
    name = lambda g: "-" if pd.isna(g) else f"={g}"

    def ends(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_place")
        names, w = x["g"].map(name).to_numpy(), x["w"].fillna(0).to_numpy(float)
        cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        single = len(cut) == 1
        left, started = _from_each_row(w[cut[-1] :], limit)
        upto = np.cumsum(w[cut[-1] :])
        few = int(np.searchsorted(upto, limit, side="right")) + 1  # the first batch starts at one of these, whatever goes before
        lists = [a[:few].tolist() if single else [] for a in (upto, left, started)]
        row = (int(x["_slice"].iloc[0]), names[0], names[-1], single, float(left[0]), int(started[0]), float(w.sum()), *lists)
        return pd.DataFrame([row], columns=["slice", "first", "last", "single", "left", "started", "total", "upto", "lefts", "starts"])

    thin = rows.select("_slice", "_place", F.col(group).cast("string").alias("g"), F.col(weight).cast("double").alias("w"))
    schema = "slice long, first string, last string, single boolean, left double, started long, total double, upto array<double>, lefts array<double>, starts array<long>"
    told = thin.groupBy("_slice").applyInPandas(ends, schema).collect()  # a row a slice, with as many numbers as a batch has rows
    entries = df.sparkSession.createDataFrame(_entries(told, limit), "_slice long, _weight double, _count long")

    def number(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_place")
        total, count, current, out = float(x["_weight"].iloc[0]), int(x["_count"].iloc[0]), None, []
        for i, (g, w) in enumerate(zip(x[group].map(name), x[weight].fillna(0).astype(float))):
            if g != current and (i or not count):
                total, count = 0.0, 0
            if not count or total + w > limit:
                total, count = 0.0, count + 1
            current, total = g, total + w
            out.append(count)
        return x[columns].assign(batch=out)

    return rows.join(F.broadcast(entries), "_slice").groupBy("_slice").applyInPandas(number, StructType([*df.schema.fields, StructField("batch", LongType())]))


def early_stop(df: DataFrame, group: str, order: str, is_recent: Column) -> DataFrame:
    """Rows of each group in order up to the first that isn't recent (null counts as recent), which reading newest first would stop at."""
    first = df.where(~F.coalesce(is_recent, F.lit(True))).groupBy(group).agg(F.min(order).alias("_stop"))
    return df.join(first, group, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def latest_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by order: enqueuing again replaces what was waiting."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}") for c in df.columns])


def after_batch(queue: DataFrame, results: DataFrame, key: str, now: Column, most_attempts: int) -> DataFrame:
    """queue (attempts, run_after, claimed_at, processed_at) after a batch's results (key, failed): done ones are processed, failed ones wait.

    Rows without a result keep their state; a failed row's lease ends, and its last attempt leaves it for good.
    """
    told = queue.join(results.select(key, F.col("failed").alias("_failed")), key, "left")
    tried, failed = F.col("_failed").isNotNull(), F.coalesce("_failed", F.lit(False))
    return told.select(
        *[
            {
                "attempts": (F.col("attempts") + tried.cast("int")).cast(queue.schema["attempts"].dataType),
                "run_after": F.when(failed, now + F.make_dt_interval(secs=backoff(F.col("attempts") + 1))).otherwise(F.col("run_after")),
                "claimed_at": F.when(~tried, F.col("claimed_at")),
                "processed_at": F.when(tried & ~failed, now).otherwise(F.col("processed_at")),
            }.get(c, F.col(c)).alias(c)
            for c in queue.columns
        ]
    )


def repooled(pools: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """pools with the rows of changed keys replaced by fresh ones; changed keys without fresh rows go. fresh should be worked out for changed keys only."""
    keys = changed.select(key).distinct()
    return pools.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def pool_sums(rows: DataFrame, owner: str, vector: str, weight: Column, sign: Column | None = None) -> DataFrame:
    """(owner, pos, n, weight, total): what weighted mean vectors are kept as: rows, weights and weighted components, added up."""
    by = F.lit(1) if sign is None else sign
    parts = rows.select(owner, by.cast("long").alias("_s"), weight.cast("double").alias("_w"), F.posexplode(vector).alias("pos", "_x")).where("_w is not null and _x is not null")
    return parts.groupBy(owner, "pos").agg(
        F.sum("_s").alias("n"), F.sum(F.col("_s") * F.col("_w")).alias("weight"), F.sum(F.col("_s") * F.col("_w") * F.col("_x").cast("double")).alias("total")
    )


def shifted_sums(sums: DataFrame, changes: DataFrame, owner: str) -> DataFrame:
    """pool_sums() after changes, which are sums of added rows and, with a sign of -1, of removed ones.

    Only owners that changes mention are added up again; owners without rows left go. A changed
    row is removed as it was and added as it is.
    """
    keys = changes.select(owner).distinct()
    touched = sums.join(keys, owner, "left_semi").unionByName(changes).groupBy(owner, "pos").agg(*[F.sum(c).alias(c) for c in ("n", "weight", "total")])
    return sums.join(keys, owner, "left_anti").unionByName(touched.where("n <> 0"))
