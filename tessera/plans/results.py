"""Saved results: brands as questions, their types of parts as what is mapped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.results import loaded, read_results, result_name
from tessera.sources.stored import shared_base
from tessera.sources.tables import table


@query("""WITH b AS (SELECT p_brand, count(DISTINCT p_type) AS parts, CASE WHEN p_brand LIKE '%5' THEN 'another_batch' WHEN p_brand LIKE '%4' THEN 'another_model' WHEN bool_or(p_size = 50) THEN 'label_not_candidate' END AS error FROM part GROUP BY 1)
SELECT p_brand AS question_id, CASE WHEN p_brand LIKE '%1' THEN 'pending' WHEN error IS NULL THEN 'completed' ELSE 'rejected' END AS status, CASE WHEN p_brand LIKE '%1' OR error IS NULL THEN '' WHEN error LIKE 'another%' AND stray THEN error || ',label_not_candidate' ELSE error END AS errors, CASE WHEN p_brand LIKE '%1' THEN 0 ELSE parts END AS mapped
FROM b JOIN (SELECT p_brand, bool_or(p_size = 50) AS stray FROM part GROUP BY 1) USING (p_brand)""")
def s13_saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result file a brand, written and loaded again: some are absent, of another batch or model, or map to strangers."""
    part, folder = table(spark, sf_dir, "part"), f"{shared_base(spark)}/results-{uuid.uuid4().hex}"
    types = part.groupBy("p_brand", "p_type").agg(F.bool_or(F.col("p_size") == 50).alias("stray"))
    mapping = F.struct(F.col("p_type").alias("part"), F.when(F.col("stray"), "stranger").otherwise(F.col("p_type")).alias("label"), F.lit("seen").alias("evidence"))
    asked = types.groupBy(F.col("p_brand").alias("question_id")).agg(F.array_sort(F.collect_list("p_type")).alias("parts"), F.array_sort(F.collect_list(mapping)).alias("mappings"))
    body = F.struct(F.when(F.col("question_id").endswith("5"), "old").otherwise("now").alias("batch_key"), F.struct(F.when(F.col("question_id").endswith("4"), "other").otherwise("model").alias("requested_model_id")).alias("execution"), F.struct("mappings").alias("result"))
    saved = asked.where(~F.col("question_id").endswith("1")).select(result_name(F.col("question_id")).alias("name"), body.alias("body"))
    saved.select("name", "body.*").repartition("name").write.partitionBy("name").json(folder)
    manifest = asked.select("question_id", F.lit("now").alias("batch_key"), F.lit("model").alias("model_id"), "parts", F.col("parts").alias("candidates"))
    found = loaded(manifest, read_results(spark, folder), strict=False)
    return found.select("question_id", "status", F.array_join("errors", ",").alias("errors"), F.coalesce(F.size("saved.result.mappings"), F.lit(0)).cast("long").alias("mapped"))
