"""Streaming queries: the folded stream equals the batch result."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.stored import shared_base
from tessera.sources.tables import table
from tessera.streaming import feed, state


def shared(spark: SparkSession) -> str:
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, user_id % 10 AS cohort, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def s01_generation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four generations; their partial sums add up to the batch result."""
    path, rows = shared(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    stream = feed.source(spark, f"{path}/in", rows.schema).withColumn("cohort", F.col("user_id") % 10)
    feed.fold(stream, ["event_type", "cohort"], {"n": F.count("*"), "total": F.sum("value")}, f"{path}/out", f"{path}/state").awaitTermination()
    return feed.folded(spark, f"{path}/out", ["event_type", "cohort"], ["n", "total"]).withColumn("total", F.bround("total", 4))


PARTS = 4


def arrivals(spark: SparkSession, rows: DataFrame, path: str) -> tuple[timedelta, int]:
    """Write rows as four arrivals by time, a tenth of each one arrival late and another tenth twice.

    The delay that admits them, and the files of a batch: as many batches as arrivals, whatever files the rows came in.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first() or (None, None)
    first, last = first or 0, last or 0
    turn = F.least(F.lit(PARTS - 1), F.floor((at - first) * PARTS / (last - first + 1)).cast("int"))
    late = F.least(F.lit(PARTS - 1), turn + 1)
    bucket = F.col("event_id") % 10
    timed = rows.withColumn("turns", F.when(bucket == 0, F.array(late)).when(bucket == 1, F.array(turn, late)).otherwise(F.array(turn)))
    for part in range(PARTS):
        timed.where(F.array_contains("turns", part)).drop("turns").write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return timedelta(seconds=(last - first) // 2_000_000 + 3600), max(1, -(-files // PARTS))


@query("""WITH u AS (SELECT user_id, max((ts, event_id)) AS b FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND (b IS NULL OR (ts, event_id) > b)) AS k FROM events LEFT JOIN u USING (user_id) GROUP BY 1""")
def w09_stateful_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases since a user's last error, by keyed state over late and repeated arrivals."""
    path, rows = shared(spark), table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("outcome"))
    delay, files = arrivals(spark, rows, f"{path}/in")
    stream = feed.source(spark, f"{path}/in", rows.schema, files)
    state.streaks(stream, ["user_id"], "purchase", "error", delay, f"{path}/out", f"{path}/state").awaitTermination()
    return state.current_streaks(spark, f"{path}/out", ["user_id"])


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'beat' END AS kind FROM events),
n AS (SELECT *, lead(ts) OVER w AS nxt, count(*) FILTER (WHERE kind = 'done') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, count(*) FILTER (WHERE kind = 'fail') OVER (PARTITION BY user_id, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM n),
t AS (SELECT user_id, CASE WHEN kind IN ('claim', 'beat') THEN 'expired' WHEN kind = 'fail' AND failures < 3 THEN 'retry' WHEN kind = 'fail' THEN 'gave_up' END AS transition, CASE WHEN kind IN ('claim', 'beat') THEN ts + INTERVAL 6 HOUR WHEN failures < 3 THEN ts + INTERVAL 12 HOUR ELSE ts END AS due, nxt FROM f),
h AS (SELECT (epoch_us(max(ts)) // 1000 - ((epoch_us(max(ts)) - epoch_us(min(ts))) // 2000000 + 3600) * 1000) * 1000 AS horizon FROM events)
SELECT user_id, transition, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS due FROM t, h WHERE transition IS NOT NULL AND (transition = 'gave_up' OR nxt IS NULL OR nxt > due) AND epoch_us(due) <= horizon""")
def s02_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that ended, tries that are due and jobs given up, up to the watermark of late and repeated arrivals."""
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("beat")
    path, rows = shared(spark), table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    delay, files = arrivals(spark, rows, f"{path}/in")
    stream = feed.source(spark, f"{path}/in", rows.schema, files)
    state.leases(stream, ["user_id"], delay, f"{path}/out", f"{path}/state", timedelta(hours=6), timedelta(hours=12)).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", "transition", F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("due"))
