"""Keyed streaming state against plain folds: late, repeated, too late and no rows."""

import random
from datetime import datetime, timedelta

from tessera.streaming import feed, state

START = datetime(2024, 1, 1)
SCHEMA = "user long, leaf string, ts timestamp, event_id long, outcome string"


def written(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return feed.source(spark, path, spark.createDataFrame([], schema).schema)


def test_streaks_with_late_and_repeated_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice(["a", None]), START + timedelta(minutes=i // 2), i, rng.choice(["ok", "ok", "ok", "seen", "bad"])) for i in range(240)]
    parts = [[] for _ in range(6)]
    for r in rows:
        at = int((r[2] - START).total_seconds() // 60) // 20
        parts[at].append(r)
        if rng.random() < 0.3 and at < 5:
            parts[at + 1].append(r)  # again
        elif rng.random() < 0.2 and at < 5:
            parts[at + 1].append(parts[at].pop())  # late, but within the delay
    never = (0, "a", START, 999, "bad")  # three hours late: dropped
    parts[5].append(never)
    stream = written(spark, f"{tmp_path}/in", parts, SCHEMA)
    state.streaks(stream, ["user", "leaf"], "ok", "bad", timedelta(minutes=41), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = {}
    for user, leaf, _, _, outcome in sorted(rows, key=lambda r: (r[2], r[3])):
        k = want.get((user, leaf), 0)
        want[user, leaf] = 0 if outcome == "bad" else k + (outcome == "ok")
    assert {(r["user"], r["leaf"]): r["k"] for r in state.current_streaks(spark, f"{tmp_path}/out", ["user", "leaf"]).collect()} == want


def test_leases_expire_retry_and_give_up(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [
        (1, at(0), 1, "claim"), (1, at(300), 2, "beat"), (1, at(601), 3, "done"),  # beaten in time, at the limit; then ended a second before done
        (2, at(0), 4, "fail"), (2, at(600), 5, "claim"), (2, at(700), 6, "fail"), (2, at(1400), 7, "fail"), (2, at(1500), 8, "done"), (2, at(1600), 9, "fail"),
        (3, at(9000), 10, "claim"),  # its limit lies beyond the last watermark
        (1, None, 11, "claim"),
    ]
    parts = [[r for i, r in enumerate(rows) if i % 3 == p] for p in (1, 0, 2)] + [[rows[0], (9, at(9001), 12, "done")]]
    stream = written(spark, f"{tmp_path}/in", parts, "job long, ts timestamp, event_id long, kind string")
    state.leases(stream, ["job"], timedelta(seconds=9001 - 2500), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["job"], r["at"] // 1_000_000 - int((START - datetime(1970, 1, 1)).total_seconds()), r["transition"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 600, "expired"), (2, 1300, "retry"), (2, 1400, "gave_up"), (2, 2200, "retry")]


def test_no_rows(spark, tmp_path):
    stream = written(spark, f"{tmp_path}/in", [[]], SCHEMA)
    state.streaks(stream, ["user", "leaf"], "ok", "bad", timedelta(minutes=1), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert state.current_streaks(spark, f"{tmp_path}/out", ["user", "leaf"]).count() == 0


def test_batches_do_not_grow_with_files(spark, tmp_path):
    from tessera.plans import streams

    rows = spark.range(0, 400, 1, 20).selectExpr("timestamp_seconds(id * 60) as ts", "id as event_id", "id % 3 as user_id")
    delay, files = streams.arrivals(spark, rows, f"{tmp_path}/in")
    written = len(spark.read.parquet(f"{tmp_path}/in").inputFiles())
    assert written > 2 * streams.PARTS and written <= files * streams.PARTS
    assert delay.total_seconds() == 399 * 60 // 2 + 3600


def test_many_files_a_batch_give_the_same_streaks(spark, tmp_path):
    from tessera.plans import streams
    from tessera.streaming import feed, state

    rows = spark.range(0, 200, 1, 8).selectExpr("timestamp_seconds(id * 60) as ts", "id as event_id", "id % 3 as user_id", "if(id % 17 = 0, 'bad', 'good') as outcome")
    delay, files = streams.arrivals(spark, rows, f"{tmp_path}/in")
    state.streaks(feed.source(spark, f"{tmp_path}/in", rows.schema, files), ["user_id"], "good", "bad", delay, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = {u: sum(1 for i in range(200) if i % 3 == u and i % 17 and i > max(b for b in range(0, 200, 17) if b % 3 == u)) for u in range(3)}
    assert {r["user_id"]: r["k"] for r in state.current_streaks(spark, f"{tmp_path}/out", ["user_id"]).collect()} == want
    assert len(list((tmp_path / "out").glob("generation=*"))) <= streams.PARTS + 2
