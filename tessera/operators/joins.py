"""Join forms: as-of, range, self-bound, unique-or-none, label-path, composite null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, valid_from: str) -> DataFrame:
    """``left`` with the right row of its keys of the latest ``valid_from`` not after ``at``; undated rows lose, ties by id.

    ``right``: keys, valid_from (nullable), id and more.  One union, one shuffle on the keys and one window: the
    right rows' state is carried forward in time order, so no pair of rows is built.
    """
    rest = [c for c in right.columns if c not in keys]
    low = F.struct(F.col(valid_from).isNotNull().alias("dated"), F.col(valid_from).alias("t"), F.lit(0).alias("side"), F.col("id").cast("string").alias("tie"))
    high = F.struct(F.lit(True).alias("dated"), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie"))
    a = right.select(*keys, low.alias("__o"), F.struct(*rest).alias("__r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"))
    b = left.select(*keys, high.alias("__o"), F.lit(None).cast(right.select(F.struct(*rest)).schema[0].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    held = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0))
    rows = a.unionByName(b).withColumn("__r", held).where("__l is not null")
    return rows.select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in rest if c not in left.columns))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points within [start, end], by an equi-join on buckets of ``width``: each range goes to the buckets it meets."""
    bucket = "__bucket"
    spread = ranges.withColumn(bucket, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    dealt = points.withColumn(bucket, F.floor(F.col(point) / width))
    return dealt.join(spread, [*(on or []), bucket]).where(F.col(point).between(F.col(start), F.col(end))).drop(bucket)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on several columns where null equals null."""
    return left.join(right, reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in pairs)), how)


def unique_or_null(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the value of the keys' only row, null where there are more."""
    return rows.groupBy(*keys).agg(F.when(F.count("*") == 1, F.first(value)).alias(value))


def one_to_one(old: DataFrame, new: DataFrame, key: str, old_id: str, new_id: str) -> DataFrame:
    """(old_id, new_id) where neither side repeats the key."""
    alone = lambda rows, i: rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(i).alias(i)).where("__n = 1").drop("__n")
    return alone(old, old_id).join(alone(new, new_id), key).select(old_id, new_id)


def matched_labels(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Questions with pairing: one answer of the same key matched, several ambiguous, none missing."""
    n = answers.groupBy(*key).agg(F.count("*").alias("__n"))
    rows = questions.join(n, key, "left")
    return rows.withColumn("pairing", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 1, "matched").otherwise("ambiguous")).drop("__n")


def overlaps(ranges: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """Ranges of a group that begin before an earlier one has ended."""
    earlier = Window.partitionBy(group).orderBy(start, end, key).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("__reach", F.max(end).over(earlier)).where(F.col("__reach") >= F.col(start)).drop("__reach")
