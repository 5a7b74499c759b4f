"""Per-key picks, ranks, caps, rotations and sampling over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in ``order`` (one shuffle, no self-join)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` of every key, by a partial maximum: hot keys stay cheap."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def average_rank(keys: list[str], order: Column, ties: list) -> Column:
    """1-based rank in which equal values share the mean of their places."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    return F.rank().over(ordered) + (F.count("*").over(Window.partitionBy(*keys, *ties)) - 1) / 2.0


def capped(rows: DataFrame, group: str, order: list, cap: int, budget: int) -> DataFrame:
    """At most ``cap`` rows of each group, then the first ``budget`` in order: what a greedy scan takes."""
    return top_per_key(rows, [group], order, cap).orderBy(*order).limit(budget)


def streak(events: DataFrame, keys: list[str], order: list[str], good: str, bad: str) -> DataFrame:
    """keys, k: ``good`` events since the last ``bad`` one, without keeping a key's events.

    Events after the last bad one are counted by a join with its place, so no list is built.
    """
    at = F.struct(*order)
    last = events.groupBy(*keys).agg(F.max(F.when(F.col("outcome") == bad, at)).alias("__bad"))
    rows = events.join(last, keys).where((F.col("outcome") == good) & (F.col("__bad").isNull() | (at > F.col("__bad"))))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("k"))
    return last.select(*keys).join(counts, keys, "left").fillna(0, ["k"])


def retained(snapshots: DataFrame, at: str, days: int, weeks: int, months: int) -> DataFrame:
    """Snapshots kept by grandfather-father-son: the newest of each of the last days, ISO weeks and months.

    ``snapshots``: id, at (timestamp). Adds ``kept_by`` (sorted array of day, week, month).
    """
    stamp = F.col(at)
    rules = (("day", F.date_format(stamp, "yyyy-MM-dd"), days), ("week", F.concat(F.extract(F.lit("YEAROFWEEK"), stamp).cast("string"), F.lit("-"), F.lpad(F.weekofyear(stamp).cast("string"), 2, "0")), weeks), ("month", F.date_format(stamp, "yyyy-MM"), months))
    kept = None
    for name, bucket, n in rules:
        newest = top_per_key(snapshots.withColumn("__bucket", bucket), ["__bucket"], [F.desc(at), F.desc("id")])
        part = newest.orderBy(F.desc("__bucket")).limit(n).select("id", F.lit(name).alias("rule"))
        kept = part if kept is None else kept.union(part)
    rules_of = kept.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("kept_by"))
    return snapshots.join(rules_of, "id")


def round_robin(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """One row of each group in turn until ``n``: groups in order of their name."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def numbered_repeats(rows: DataFrame, label: str, order: list) -> Column:
    """The label, with ``.repeatN`` from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(".repeat"), n.cast("string")))
