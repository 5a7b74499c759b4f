"""Saved results of review runs: one JSON file a question, found by name, checked against the manifest that asked for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.gates import codes

#: What a result file holds besides columns of the reader's own.
EXECUTION = "execution struct<requested_model_id:string>"
MAPPINGS = "result struct<mappings:array<struct<part:string,label:string,evidence:string>>>"


def result_name(question: Column) -> Column:
    """The file of a question: the SHA-256 of its id as a JSON string."""
    return F.sha2(F.to_json(F.array(question)).substr(F.lit(2), F.length(F.to_json(F.array(question))) - 2), 256)


def read_results(spark: SparkSession, folder: str, content: str = MAPPINGS) -> DataFrame:
    """name, saved of the JSON files under a folder; ``saved`` is null where a file isn't such a record.

    A file's name is its own without the ending, or that of the folder that a writer's partition gave it (name=...).
    """
    schema = f"batch_key string, {EXECUTION}, {content}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"/name=([0-9a-f]+)/[^/]*$", 1), F.lit("")), F.regexp_extract(path, r"([^/]*)\.json$", 1))
    return files.select(name.alias("name"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("saved"))


def loaded(manifest: DataFrame, results: DataFrame, strict: bool = True) -> DataFrame:
    """question_id, status (completed, pending or rejected), errors, saved: every question of a manifest.

    ``manifest``: question_id, batch_key, model_id, parts (array), candidates (array).  A missing file is a question that
    is still pending.  Another batch, another model, an unreadable file or a mapping that can't stand reject a result:
    ``strict`` raises on the first, else ``errors`` says what.  Files that the manifest doesn't ask for are left aside.
    """
    rows = manifest.withColumn("__name", result_name(F.col("question_id").cast("string"))).join(results.withColumnRenamed("name", "__name").withColumn("__there", F.lit(True)), "__name", "left")
    saved, given = F.col("saved"), F.col("saved.result.mappings")
    parts = F.transform(given, lambda g: g["part"])
    whole = saved.isNotNull() & saved["batch_key"].isNotNull()
    errors = codes([
        ("unreadable", F.col("__there") & ~whole),
        ("another_batch", whole & ~saved["batch_key"].eqNullSafe(F.col("batch_key"))),
        ("another_model", whole & ~saved["execution"]["requested_model_id"].eqNullSafe(F.col("model_id"))),
        ("parts_differ", whole & ~F.coalesce(F.array_sort(parts) == F.array_sort(F.col("parts")), F.lit(False))),
        ("label_not_candidate", whole & F.coalesce(F.exists(given, lambda g: g["label"].isNotNull() & ~F.array_contains("candidates", g["label"])), F.lit(False))),
        ("evidence_missing", whole & F.coalesce(F.exists(given, lambda g: F.coalesce(g["evidence"], F.lit("")) == ""), F.lit(False))),
    ])
    checked = rows.withColumn("errors", errors)
    if strict:
        why = F.concat(F.lit("result of "), F.col("question_id").cast("string"), F.lit(": "), F.array_join("errors", ", "))
        checked = checked.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(why).cast("array<string>")).otherwise(F.col("errors")))
    status = F.when(F.size("errors") > 0, "rejected").when(F.col("__there"), "completed").otherwise("pending")
    return checked.select("question_id", status.alias("status"), "errors", "saved")
