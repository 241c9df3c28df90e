"""State by key with timers: exact trailing counts on streams, and a queue with leases and backoff."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the state store of keyed streams must be.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Trailing(StatefulProcessor):
    """Events of one key wait until the watermark has passed them; failures stay as long as an event can still count them."""

    def __init__(self, seconds: int, columns: list[str]):
        self.span, self.columns = seconds * 1_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, at long")
        self.failures = handle.getListState("failures", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[int, int]] = []
        failures: list[tuple[int]] = []
        for x in rows:
            at = x["micros"].astype("int64").tolist()
            waiting += list(zip(x["id"].astype("int64").tolist(), at, strict=True))
            failures += [(t,) for t, bad in zip(at, x["bad"].tolist(), strict=True) if bad]
        if waiting:
            self.waiting.appendList(waiting)
            self.handle.registerTimer(max(min(t for _, t in waiting) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if failures:
            self.failures.appendList(failures)
        yield pd.DataFrame({c: [] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        times = np.sort(np.array([t for (t,) in self.failures.get()] if self.failures.exists() else [], np.int64))
        told = [(i, t) for i, t in waiting if t < passed]
        left = [(i, t) for i, t in waiting if t >= passed]
        at = np.array([t for _, t in told], np.int64)
        count = np.searchsorted(times, at, "left") - np.searchsorted(times, at - self.span, "right")
        # no event before the watermark will come, so only the span before it still counts
        kept = times[times > min([passed, *(t for _, t in left)]) - self.span]
        for state, values in ((self.waiting, left), (self.failures, [(int(t),) for t in kept])):
            if values:
                state.put(values)
            else:
                state.clear()
        if left:
            self.handle.registerTimer(min(t for _, t in left) // 1000 + 1)
        elif len(kept):
            self.handle.registerTimer(int(kept[-1] + self.span) // 1000 + 1)
        names = self.columns
        yield pd.DataFrame({names[0]: [key[0]] * len(told), names[1]: [i for i, _ in told], names[2]: count.astype("int64")})

    def close(self) -> None:
        pass


def trailing_failures(events: DataFrame, user: str, id_col: str, ts: str, failed: Column, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(user, id, prior_failures) of each event: its user's failures in the time before it that is shorter than `seconds`, as in batch form.

    Exact, for events up to `lateness` out of order; an event comes out once the watermark has
    passed it. State holds what waits and the failures that can still count, by user; a user
    of whom neither is left holds none, and timers see to that. The session's state store must
    be STORE. Events without an id, a user or a time are left out.
    """
    rows = events.where(F.col(id_col).isNotNull() & F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(user).alias("owner"), F.col(id_col).cast("long").alias("id"), F.col(ts).alias("happened"), F.unix_micros(ts).alias("micros"), F.coalesce(failed, F.lit(False)).alias("bad")
    )
    kind = rows.schema["owner"].dataType.simpleString()
    processor = _Trailing(seconds, [user, id_col, "prior_failures"])
    return rows.withWatermark("happened", lateness).groupBy("owner").transformWithStateInPandas(processor, f"`{user}` {kind}, `{id_col}` long, prior_failures long", "append", "eventTime")


def doubling(attempt: int) -> int:
    """Seconds until an attempt that failed may be made again: as numbers.backoff."""
    return min(2 ** min(attempt, 6), 3600)


class _Queue(StatefulProcessor):
    """One id: its latest change, how often it was handed out, and when that lease ends or it may run again."""

    FIELDS = "version long, attempts int, leased boolean, due long, payload string"

    def __init__(self, by_event: bool, lease: int, most: int, backoff: Callable[[int], float], columns: list[str]):
        self.by_event, self.lease, self.most, self.backoff, self.columns = by_event, lease * 1000, most, backoff, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.FIELDS)

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.by_event else times.getCurrentProcessingTimeInMs()

    def _settle(self, key, old, new, now: int) -> pd.DataFrame:
        """Hand out or park what is due, keep the rest with one timer; the rows that come out."""
        out = []
        if new is not None and new[3] <= now:
            version, attempts, _, _, payload = new
            parked = attempts >= self.most
            out.append((key[0], version, attempts if parked else attempts + 1, "parked" if parked else "claimed", payload))
            new = None if parked else (version, attempts + 1, True, now + self.lease, payload)
        if old is not None and (new is None or new[3] != old[3]) and old[3] in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[3])
        if new is None:
            self.held.clear()
        elif new != old:
            self.held.update(new)
            if old is None or new[3] != old[3]:
                self.handle.registerTimer(new[3])
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, old = self._now(timerValues), tuple(self.held.get()) if self.held.exists() else None
        new, changes, ends = old, [], set()
        for x in rows:
            for kind, version, number, due, payload in zip(x["kind"], x["version"].tolist(), x["attempt"].tolist(), x["due"].tolist(), x["payload"], strict=True):
                if kind == "change":
                    changes.append((version, due, payload or "", payload))
                elif old is not None and old[2] and old[:2] == (version, number):
                    ends.add(kind)  # only the attempt that holds the lease can end it
        if "done" in ends:
            new = None
        elif ends:
            wait = 0 if old[1] >= self.most else int(self.backoff(old[1]) * 1000)
            new = (*old[:2], False, now + wait, old[4])
        if changes:
            version, due, _, payload = max(changes, key=lambda c: c[:3])
            if old is None or version > old[0]:
                new = (version, 0, False, due, payload)
        yield self._settle(key, old, new, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = tuple(self.held.get()) if self.held.exists() else None
        if old is None:
            yield pd.DataFrame(columns=self.columns)
        else:
            yield self._settle(key, old, old, self._now(timerValues))

    def close(self) -> None:
        pass


def queue(
    changes: DataFrame,
    results: DataFrame,
    lease_seconds: int = 60,
    most_attempts: int = 8,
    backoff: Callable[[int], float] = doubling,
    clock: str = "processing",
    lateness: str = "0 seconds",
) -> DataFrame:
    """(id, enqueued_at, attempt, status, payload): what is handed out to workers, and what is given up.

    changes has id, enqueued_at, run_after (null: at once) and payload (a string; null stays null);
    results has id, enqueued_at and attempt of a row that was handed out, and failed. Nothing is
    rewritten a micro-batch: state is kept by id, its live ones only. A row comes out as claimed
    once it is due; the worker then holds it for the lease. A failure waits for its backoff and a
    lease that ends without a result comes out again at once, both by timers; after most_attempts
    the row comes out as parked and is forgotten. A later change of an id replaces what waits or
    is held, an equal or older one changes nothing while the row lives; results of any but the held attempt are
    ignored, so a worker that lost its lease can't end another's; of two for one attempt, success counts. Changes that come with a result
    of the same micro-batch come after it.

    The clock is the machine's, or with "event" the watermark over the column `at` that both
    streams then have (later rows than lateness are left out). Rows without an id are left out;
    a change without enqueued_at counts as the oldest. The session's state store must be STORE.
    """
    by_event = clock == "event"
    time = [F.col("at")] if by_event else []
    version = F.coalesce(F.unix_micros("enqueued_at"), F.lit(-(2**62))).alias("version")
    due = F.coalesce(F.unix_millis("run_after"), F.lit(0))
    put = changes.select("id", F.lit("change").alias("kind"), version, F.lit(0).alias("attempt"), due.alias("due"), F.col("payload").cast("string").alias("payload"), *time)
    kind = F.when(F.coalesce("failed", F.lit(True)), "failed").otherwise("done").alias("kind")
    told = results.select("id", kind, version, F.coalesce(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"), F.lit(0).cast("long").alias("due"), F.lit(None).cast("string").alias("payload"), *time)
    rows = put.unionByName(told).where("id is not null")
    if by_event:
        rows = rows.withWatermark("at", lateness)
    names = ["id", "version", "attempt", "status", "payload"]
    processor = _Queue(by_event, lease_seconds, most_attempts, backoff, names)
    kind_of_id = changes.schema["id"].dataType.simpleString()
    made = rows.groupBy("id").transformWithStateInPandas(processor, f"id {kind_of_id}, version long, attempt int, status string, payload string", "append", "eventTime" if by_event else "processingTime")
    known = F.when(F.col("version") > -(2**62), F.timestamp_micros("version"))
    return made.select("id", known.alias("enqueued_at"), "attempt", "status", "payload")
