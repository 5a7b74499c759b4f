"""Keyed state over event streams: streaks with reset, and leases with expiry and retry by event-time timers.

Both take rows in any order within the watermark's delay, and the same row more than once: rows stand under their
place (time, id) until no row before them can come any more.  What a key holds is therefore bounded by the rows of one
delay, not by its history.  Rows later than the watermark are dropped by the engine.  State lives in RocksDB and is
checkpointed with the stream, so a lost executor's keys are restored elsewhere; outputs are written by batch number,
so a batch that is run again replaces its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = "at long, id long"


class Streak(StatefulProcessor):
    """k of each key: ``good`` rows after the last ``bad`` one.

    Places of good rows stay only while a bad row between them can still come; earlier ones are a count.
    """

    def __init__(self, good: str, bad: str, key_names: tuple[str, ...]):
        self.good, self.bad, self.key_names = good, bad, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "settled long, bad_at long, bad_id long, mark long")
        self.recent = handle.getListState("recent", PLACE)  # read and put whole: a call a key, not one a row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, bad_at, bad_id, mark = self.sums.get() or (0, None, None, None)
        bad = None if bad_at is None else (bad_at, bad_id)
        places = {tuple(p) for p in self.recent.get()}
        held = set(places)
        for part in rows:
            for at, row_id, outcome in zip(part["place_at"].tolist(), part["place_id"].tolist(), part["outcome"].tolist()):
                if outcome == self.bad and (bad is None or (at, row_id) > bad):
                    bad, settled = (at, row_id), 0  # every settled row is older than any row that isn't late
                elif outcome == self.good:
                    places.add((at, row_id))
        if bad is not None:
            places = {p for p in places if p > bad}
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if mark is not None and now > mark:  # rows up to the mark of an earlier batch are late from now on
            done = {p for p in places if p[0] <= mark}
            settled, places = settled + len(done), places - done
        if not places and held:
            self.recent.clear()
        elif places != held:
            self.recent.put(sorted(places))
        self.sums.update((settled, bad and bad[0], bad and bad[1], now))
        yield pd.DataFrame({**{n: [v] for n, v in zip(self.key_names, key)}, "k": [settled + len(places)]})

    def close(self) -> None:
        pass


class Lease(StatefulProcessor):
    """Transitions of each job: a lease ends unless a next row comes in time, a failure is tried again, or given up.

    Rows wait until the watermark passes them and are then taken in order of their places, by timers.  ``claim`` and
    ``beat`` open or extend a lease of ``lease`` microseconds; ``fail`` asks for another try after ``retry`` unless it
    is the ``most``-th since the last ``done``; any row before a deadline, or at it, cancels that deadline.
    """

    def __init__(self, lease: int, retry: int, most: int, key_names: tuple[str, ...]):
        self.lease, self.retry, self.most, self.key_names = lease, retry, most, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "kind string, due long, failures long")
        self.waiting = handle.getListState("waiting", f"{PLACE}, kind string")  # appended and read in one call, repeats included

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            came = list(zip(part["place_at"].tolist(), part["place_id"].tolist(), part["kind"].tolist()))
            if came:
                self.waiting.appendList(came)
                first = min(c[0] for c in came) if first is None else min(first, min(c[0] for c in came))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield from ()  # rows come out of timers only

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        kind, due, failures = self.current.get() or (None, None, 0)
        held = {(at, row_id): k for at, row_id, k in self.waiting.get()}  # a repeated row is one
        waiting = sorted(held.items())
        left = [p for p, _ in waiting if p[0] > now]
        for place, k in waiting[: len(waiting) - len(left)]:
            if due is not None and due < place[0]:
                out.append((kind, due))
            kind, due = None, None
            if k in ("claim", "beat"):
                kind, due = "expired", place[0] + self.lease
            elif k == "done":
                failures = 0
            elif k == "fail":
                failures += 1
                if failures < self.most:
                    kind, due = "retry", place[0] + self.retry
                else:
                    out.append(("gave_up", place[0]))
        if left:
            if len(left) < len(waiting):
                self.waiting.put([(*p, held[p]) for p in left])
        elif held:
            self.waiting.clear()
        if due is not None and due <= now:
            out.append((kind, due))
            kind, due = None, None
        self.current.update((kind, due, failures))
        follow = [t for t in (left[0][0] if left else None, due) if t is not None]
        if follow:
            self.handle.registerTimer(min(follow) // 1000)
        if out:
            yield self._out(key, out)

    def _out(self, key, rows: list[tuple[str, int]]) -> pd.DataFrame:
        frame = pd.DataFrame({n: [v] * len(rows) for n, v in zip(self.key_names, key)})
        return frame.assign(transition=pd.Series([r[0] for r in rows], dtype=object), at=pd.Series([r[1] for r in rows], dtype="int64"))

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, result: str, value: str, delay: timedelta, path: str, checkpoint: str) -> StreamingQuery:
    """One output folder a batch; runs over what is available and stops.  A null time or id has no place and is left out."""
    spark, types = stream.sparkSession, dict(stream.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), result])
    placed = stream.where("ts is not null and event_id is not null").select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("place_id"), value)
    timed = placed.withWatermark("ts", f"{int(delay.total_seconds())} seconds").withColumn("place_at", F.unix_micros("ts"))
    out = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "EventTime")

    def batch(rows: DataFrame, generation: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/generation={generation}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings that it was started with
        return out.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def streaks(stream: DataFrame, keys: list[str], good: str, bad: str, delay: timedelta, path: str, checkpoint: str) -> StreamingQuery:
    """Streak of each key after each batch that touched it; ``stream``: keys, ts, event_id, outcome."""
    return _run(stream, keys, Streak(good, bad, tuple(keys)), "k long", "outcome", delay, path, checkpoint)


def current_streaks(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys, k: what the last batch that touched a key left."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("k", "generation").alias("k"))


def leases(stream: DataFrame, keys: list[str], delay: timedelta, path: str, checkpoint: str, lease: timedelta = timedelta(seconds=300), retry: timedelta = timedelta(minutes=10), most: int = 3) -> StreamingQuery:
    """keys, transition (expired, retry or gave_up), at (microseconds); ``stream``: keys, ts, event_id, kind.

    A transition comes out once the watermark has passed it.
    """
    micros = lambda t: t // timedelta(microseconds=1)
    return _run(stream, keys, Lease(micros(lease), micros(retry), most, tuple(keys)), "transition string, at long", "kind", delay, path, checkpoint)
