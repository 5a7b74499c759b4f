"""Sinks: partitioned runs with a current pointer, keyed upserts, idempotent appends, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.windows import latest


def write_run(rows: DataFrame, path: str, run_id: int) -> None:
    """One write-once partition a run."""
    rows.withColumn("score_run_id", F.lit(run_id).cast("long")).write.partitionBy("score_run_id").mode("append").parquet(path)


def promote(spark: SparkSession, path: str, run_id: int, generation: int) -> bool:
    """Make a run current unless a run of a greater (generation, id) was promoted; the pointer is an appended row."""
    current = current_run(spark, path)
    if current and (current["generation"], current["run_id"]) >= (generation, run_id):
        return False
    spark.createDataFrame([(run_id, generation)], "run_id long, generation long").coalesce(1).write.mode("append").parquet(path)
    return True


def current_run(spark: SparkSession, path: str):
    """The pointer's row, or None before any promotion."""
    try:
        rows = spark.read.schema("run_id long, generation long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows.orderBy(F.desc("generation"), F.desc("run_id")).first()


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_greatest(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key with its greatest value: coalesced, idempotent requests."""
    return old.unionByName(new).groupBy(*keys).agg(F.max(value).alias(value))


def appended_once(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``new`` without keys that ``old`` has, one row (the latest) a key."""
    return latest(new, keys, order).join(old.select(*keys), keys, "left_anti")


def export_user(tables: dict[str, DataFrame], user: int, path: str, column: str = "user_id") -> None:
    """One JSON folder a table with one user's rows."""
    for name, rows in tables.items():
        rows.where(F.col(column) == user).write.mode("overwrite").json(f"{path}/{name}")
