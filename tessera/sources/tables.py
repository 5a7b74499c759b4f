"""Readers of the driver tables and of nested registry files, with explicit schemas."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.scoring import ScoringConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of tables' files that one partition of their rows may come from.
PARTITION_BYTES = 4 << 20


def partitions(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """How many partitions rows of these tables are dealt to: the session's, or more by the size of the files.

    A task's sorts and hash tables then keep their size however large the tables are.
    """
    size = 0
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def filtered(rows: DataFrame, given: dict) -> DataFrame:
    """Rows that equal every given value; None leaves a column free, a list admits any of its values."""
    for name, value in given.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return rows


def pending(rows: DataFrame, statuses: list[str], status: str = "status", key: str = "id") -> DataFrame:
    """Catalogue rows of some statuses, newest id first."""
    return rows.where(F.col(status).isin(statuses)).orderBy(F.desc(key))


def read_manifest(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """JSON documents (one object a file) under one schema; a later path's rows follow an earlier one's."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """id, parent_id, level, name, seq from a nested JSON tree of {id, name, children}, levels by depth."""
    levels = ("module", "chapter", "topic", "subtopic")
    with open(path) as f:
        roots, rows = json.load(f), []

    def walk(node: dict, parent: str | None, depth: int, seq: int) -> None:
        rows.append((node["id"], parent, levels[min(depth, 3)], node.get("name", ""), seq))
        for i, child in enumerate(node.get("children", [])):
            walk(child, node["id"], depth + 1, i)

    for i, root in enumerate(roots):
        walk(root, None, 0, i)
    return spark.createDataFrame(rows, "id string, parent_id string, level string, name string, seq int")


def read_config(path: str) -> ScoringConfig:
    """Scoring constants from TOML; what is absent keeps its default."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    weights, plan = given.get("weights", {}), given.get("plan", {})
    named = {
        "half_life_exam": given.get("half_life_exam_months"), "half_life_practice": given.get("half_life_practice_months"), "cross_paper_factor": given.get("p6_cross_paper_factor"),
        "stale_factor": given.get("law_stale_factor"), "window_attempts": given.get("freq_window_attempts"), "weak_min_hits": given.get("weak_flag_min_hits"),
        "weight_exam": weights.get("exam"), "weight_practice": weights.get("practice"), "weight_prior": weights.get("prior"),
        "per_chapter_cap": plan.get("per_chapter_cap"), "weak_boost": plan.get("weak_boost"), "in_progress_boost": plan.get("in_progress_boost"),
    }
    return ScoringConfig(**{k: v for k, v in named.items() if v is not None})


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, sha256 of files under a folder, by the binary source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
