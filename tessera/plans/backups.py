"""Backups of orders, restored with faults: what verification finds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import backups
from tessera.sources.stored import shared_base
from tessera.sources.tables import table


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'changed' END AS change FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 400000 AND o_orderpriority <> '1-URGENT')
UNION ALL SELECT -o_orderkey - 1, 'unexpected' FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice < 30000""")
def k10_restore_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a restored table that differ from its backup: lost partial orders, dear ones made urgent, and strangers."""
    orders, path = table(spark, sf_dir, "orders"), f"{shared_base(spark)}/backup-{uuid.uuid4().hex}"
    backups.backup(spark, {"orders": (orders, ["o_orderkey"])}, path)
    back = backups.restored(spark, path, "orders")
    faulty = back.where("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 400000, "1-URGENT").otherwise(F.col("o_orderpriority")))
    strangers = back.where("o_orderpriority = '5-LOW' and o_totalprice < 30000").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return backups.differences(spark, path, "orders", faulty.unionByName(strangers), ["o_orderkey"])


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT substr(md5(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 4)) AS BIGINT) AS leaves, CAST(count(DISTINCT substr(md5(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 1)) AS BIGINT) AS top FROM orders")
def k10_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of a table's digest tree: rows, leaves, nodes under the root."""
    tree = backups.digest_tree(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return tree.agg(F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("n"))), F.lit(0)).alias("n"), F.count_if(F.col("level") == backups.DEPTH).alias("leaves"), F.count_if(F.col("level") == 1).alias("top"))
