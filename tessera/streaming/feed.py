"""The change feed: batches of dated appearances as a stream, with guarded, idempotent folding.

The batch id is the generation.  ``foreachBatch`` coalesces a batch's contexts, adds its evidence sums as one
write-once partition, and a reader sums the partitions of distinct generations: a batch that is replayed after
a failure overwrites its own partition, so results are exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold(stream: DataFrame, keys: list[str], sums: dict, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's partial sums by ``keys`` under its generation; runs over what is available and stops."""

    def batch(rows: DataFrame, generation: int) -> None:
        part = rows.groupBy(*keys).agg(*(e.alias(n) for n, e in sums.items()))
        part.write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The state after all generations."""
    return spark.read.parquet(path).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums))


def streaks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Streaks with reset of an event stream, one row a batch, user and leaf: ``since`` good events after the last bad one.

    Events of a batch follow those of earlier ones; ``merged_streaks`` joins the batches' rows.
    """

    def batch(rows: DataFrame, generation: int) -> None:
        at = F.struct("ts", "event_id")
        last = rows.groupBy("user_id", "leaf").agg(F.max(F.when(F.col("outcome") == "shaky", at)).alias("bad"))
        part = rows.join(last, ["user_id", "leaf"]).groupBy("user_id", "leaf").agg(F.bool_or(F.col("bad").isNotNull()).alias("reset"), F.count_if((F.col("outcome") == "ok") & (F.col("bad").isNull() | (at > F.col("bad")))).alias("since"))
        part.write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_streaks(spark: SparkSession, path: str) -> DataFrame:
    """user_id, leaf, k: good events since the last generation with a reset, that one's own included."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("user_id", "leaf").agg(F.max(F.when(F.col("reset"), F.col("generation"))).alias("at"))
    kept = rows.join(last, ["user_id", "leaf"]).where("at is null or generation >= at")
    return kept.groupBy("user_id", "leaf").agg(F.sum("since").alias("k"))
