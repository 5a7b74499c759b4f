"""Backups of tables with a manifest and a digest tree each; restored tables are verified by descending the tree.

A tree's leaves are ranges of the keys' hash: four hex digits, so 65,536 of them at most whatever the table.  A node's
digest is the sum of its rows' hashes, hence of its children's, so one pass with map-side combination gives all levels.
Verification compares the roots, then only children of nodes that differ, and reads whole rows of differing leaves alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.compare import row_md5
from tessera.sources.stored import exists

DEPTH = 4
MANIFEST = "name string, keys array<string>, schema string, n long, digest string"


def leaf_of(rows: DataFrame, keys: list[str]):
    """The hash range of a row's key."""
    return F.substring(row_md5(rows, keys), 1, DEPTH)


def digest_tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """level, prefix, n, a, b: nodes of all levels from the root (level 0, prefix '') to the leaves."""
    row = row_md5(rows, rows.columns)
    part = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")
    leaves = rows.select(leaf_of(rows, keys).alias("leaf"), part(1).alias("a"), part(9).alias("b")).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    levels = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "leaf", "n", "a", "b")
    nodes = levels.groupBy("level", F.substring("leaf", F.lit(1), F.col("level")).alias("prefix"))
    return nodes.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def root(tree: DataFrame) -> tuple[int, str]:
    """(n, digest) of a whole table; an empty one has no node."""
    found = tree.where("level = 0").first()
    return (found["n"], f"{found['a']}-{found['b']}") if found else (0, "0-0")


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """prefix of the leaves in which two trees differ, found level by level under the nodes that differ."""
    open_ = None
    for level in range(DEPTH + 1):
        a, b = (t.where(F.col("level") == level).select("prefix", F.struct("n", "a", "b").alias(name)) for t, name in ((old, "__a"), (new, "__b")))
        if open_ is not None:
            a, b = (t.join(open_, F.substring("prefix", 1, level - 1) == F.col("__above"), "left_semi") for t in (a, b))
        found = a.join(b, "prefix", "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("prefix")
        open_ = found.withColumnRenamed("prefix", "__above")
    return found


def located(old: DataFrame, new: DataFrame, keys: list[str], leaves: DataFrame) -> DataFrame:
    """keys, change (missing, unexpected or changed) of the rows that differ, from rows of the given leaves.

    Rows that repeat a key are compared as multisets: a key whose rows aren't the same on both sides is changed.
    """
    in_leaves = lambda rows: rows.join(leaves, leaf_of(rows, keys) == F.col("prefix"), "left_semi")
    side = lambda rows, name: in_leaves(rows).select(*keys, row_md5(rows, rows.columns).alias("__row")).groupBy(*keys).agg(F.array_sort(F.collect_list("__row")).alias(name))
    a, b = side(old, "__old"), side(new, "__new")
    renamed = b.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__new")
    same = None
    for k in keys:
        each = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        same = each if same is None else same & each
    both = a.join(renamed, same, "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    change = F.when(F.col("__old").isNull(), "unexpected").when(F.col("__new").isNull(), "missing").otherwise("changed")
    return both.select(*(F.coalesce(F.col(k), F.col(f"__k_{k}")).alias(k) for k in keys), change.alias("change"))


def backup(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Write tables (frame, keys), their trees and, last of all, the manifest; a backup without a manifest is no backup."""
    if exists(spark, f"{path}/manifest"):
        raise ValueError(f"there is a backup at {path}")
    entries = []
    for name, (rows, keys) in sorted(tables.items()):
        rows.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        saved = spark.read.schema(rows.schema).parquet(f"{path}/tables/{name}")
        digest_tree(saved, keys).write.mode("overwrite").partitionBy("level").parquet(f"{path}/trees/{name}")
        n, digest = root(tree_of(spark, path, name))
        entries.append((name, keys, rows.schema.json(), n, digest))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, keys, schema, n, digest of each table of a whole backup."""
    if not exists(spark, f"{path}/manifest"):
        raise ValueError(f"no whole backup at {path}")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def tree_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema("prefix string, n long, a decimal(38,0), b decimal(38,0), level int").parquet(f"{path}/trees/{name}")


def restored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tables/{name}")


def verified(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, intact | missing | unexpected | schema | differs) of restored tables against the manifest, sorted by name."""
    saved = {m["name"]: m for m in manifest(spark, path).collect()}  # a row a table
    out = [(name, "unexpected") for name in tables.keys() - saved.keys()] + [(name, "missing") for name in saved.keys() - tables.keys()]
    for name in saved.keys() & tables.keys():
        was, rows = saved[name], tables[name]
        if was["schema"] != rows.schema.json():
            out.append((name, "schema"))
        else:
            out.append((name, "intact" if root(digest_tree(rows, was["keys"])) == (was["n"], was["digest"]) else "differs"))
    return sorted(out)


def differences(spark: SparkSession, path: str, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change of the rows of a restored table that differ from the backup's."""
    leaves = differing_leaves(tree_of(spark, path, name), digest_tree(rows, keys))
    return located(restored(spark, path, name), rows, keys, leaves)
