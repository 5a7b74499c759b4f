"""Sort, set and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_size DESC NULLS LAST, p_partkey) AS place FROM part")
def o01_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.tree import positions

    rows = positions(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.desc_nulls_last("p_size"), F.asc("p_partkey")], "place")
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic DESC NULLS FIRST, doc_id LIMIT 30")
def o02_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending with nulls first, stated as such."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_first("toxic"), "doc_id").limit(30)


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def o04_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by a stable key, with the total of the unpaged query."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("o_orderkey").offset(50).limit(25).crossJoin(F.broadcast(total))


@query("SELECT DISTINCT source FROM documents ORDER BY source LIMIT 12")
def o06_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").limit(12)


@query("""SELECT DISTINCT ON (k) k, origin, at_id FROM (SELECT o_custkey AS k, 'run' AS origin, o_orderkey AS at_id FROM orders UNION ALL SELECT user_id, 'job', event_id FROM events) ORDER BY k, at_id DESC, origin""")
def u01_union_then_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of runs and jobs of each context; runs before jobs of equal ids are the lesser."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("run").alias("origin"), F.col("o_orderkey").alias("at_id"))
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.lit("job").alias("origin"), F.col("event_id").alias("at_id"))
    return runs.unionByName(jobs).groupBy("k").agg(F.min_by("origin", F.struct(-F.col("at_id"), "origin")).alias("origin"), F.max("at_id").alias("at_id"))


@query("(SELECT DISTINCT l_partkey AS k, 'both' AS side FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_returnflag = 'A') UNION ALL (SELECT k, 'only returned' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'))")
def u02_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of two id sets in one aggregation."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')")
    sides = lines.groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    return sides.where("r").select("k", F.when(F.col("a"), "both").otherwise("only returned").alias("side"))


@query("WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS x, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS y FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) = 0 THEN 1 ELSE round_even(len(list_intersect(coalesce(x, []), coalesce(y, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), 4) END AS jaccard FROM s")
def u03_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(part("F").alias("x"), part("O").alias("y"))
    return rows.select("o_custkey", C.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'new' WHEN o_orderpriority = '1-URGENT' THEN 'missing' WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'unchanged' END AS change FROM orders")
def u07_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low orders are new, urgent ones gone, the price of fulfilled ones has changed."""
    orders = table(spark, sf_dir, "orders")
    new = orders.where("o_orderpriority != '1-URGENT'").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return C.row_diff(orders.where("o_orderpriority != '5-LOW'"), new, "o_orderkey", "o_totalprice")


@query("SELECT doc_id, md5('11' || doc_id) AS draw FROM documents ORDER BY draw LIMIT 25")
def u08_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("11"), F.col("doc_id").cast("string"))).alias("draw")).orderBy("draw").limit(25)


@query("""WITH h AS (SELECT o_orderstatus, md5(strlen(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || strlen(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || strlen(o_orderpriority) || ':' || o_orderpriority) AS m FROM orders)
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS VARCHAR) AS digest FROM h GROUP BY 1""")
def q25_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-insensitive digest of row contents by status."""
    return C.multiset_digest(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderstatus"])


@query("SELECT p_type, count(*) AS n, round_even(corr(rank_x, rank_y), 4) AS rho FROM (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS rank_x, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0::DOUBLE AS rank_y FROM part) GROUP BY 1")
def m08_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spearman(table(spark, sf_dir, "part").select("p_type", "p_size", "p_retailprice"), ["p_type"], "p_size", "p_retailprice")
