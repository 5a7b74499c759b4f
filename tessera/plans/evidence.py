"""Consistency, queues, catalogues and other queries over review evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.windows import latest
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("SELECT o_orderkey, CASE WHEN r1 = r2 AND (anchor IS NULL OR anchor = r1) THEN 'A' WHEN r1 = r2 THEN 'B' WHEN r3 = r1 OR r3 = r2 THEN 'C' ELSE 'D' END AS bucket FROM (SELECT o_orderkey, o_orderkey % 3 AS r1, o_custkey % 3 AS r2, (o_orderkey + o_custkey) % 3 AS r3, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 2 END AS anchor FROM orders)")
def n01_consistency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes and an anchor decide the bucket."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("r1"), (F.col("o_custkey") % 3).alias("r2"), ((F.col("o_orderkey") + F.col("o_custkey")) % 3).alias("r3"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 2).alias("anchor"))
    agree = F.col("r1") == F.col("r2")
    bucket = F.when(agree & (F.col("anchor").isNull() | (F.col("anchor") == F.col("r1"))), "A").when(agree, "B").when((F.col("r3") == F.col("r1")) | (F.col("r3") == F.col("r2")), "C").otherwise("D")
    return o.select("o_orderkey", bucket.alias("bucket"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE o_orderstatus IN ('O', 'P') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 50")
def q12_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items without a dispute, filtered before the page is cut."""
    disputed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).join(disputed, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return rows.orderBy(F.desc_nulls_first("o_orderpriority"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'view') AND (value IS NULL OR value <= 20) AND CAST(json_extract(props, '$.k') AS BIGINT) < 75 ORDER BY (event_type = 'error') DESC, event_id DESC LIMIT 40")
def f08_retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed or never tried, idle long enough, with tries left (k counts them); the next forty, failures first."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view") & (F.col("value").isNull() | (F.col("value") <= 20)) & (F.get_json_object("props", "$.k").cast("long") < 75))
    return rows.orderBy((F.col("event_type") == "error").desc(), F.desc("event_id")).limit(40).select("event_id", "user_id")


@query("SELECT p_partkey FROM part WHERE p_name = 'red widget' OR p_name LIKE '%.red widget' OR p_name LIKE '%bolt'")
def f04_equal_or_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").where((name == "red widget") | name.endswith(".red widget") | name.endswith("bolt")).select("p_partkey")


@query("SELECT doc_id, quality IS NOT DISTINCT FROM toxic AS same FROM documents LEFT JOIN labels USING (doc_id)")
def f05_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").eqNullSafe(F.col("toxic")).alias("same"))


@query("SELECT o_custkey, o_orderpriority, max(o_orderkey) AS generation FROM orders GROUP BY ALL")
def k05_coalesced_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending jobs of one context coalesce to the greatest generation."""
    from tessera.sources.sinks import upsert_greatest

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("generation"))
    return upsert_greatest(rows.where("generation % 2 = 0"), rows.where("generation % 2 = 1"), ["o_custkey", "o_orderpriority"], "generation")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def k04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and urgent orders come anew at twice the price; the others, urgent ones too, are what was there."""
    from tessera.sources.sinks import upserted

    rows, is_open = table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "price"), F.col("o_orderstatus").eqNullSafe("O")
    new = rows.where(is_open | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", (F.col("price") * 2).alias("price"))
    return upserted(rows.where(~is_open).select("o_orderkey", "price"), new, ["o_orderkey"])


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def n56_latest_non_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").where("event_type != 'error'").select("user_id", "event_id", "ts"), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT o_custkey, CASE WHEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') > coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), -1) THEN 'pending' WHEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') IS NULL THEN 'unavailable' WHEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') > max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') THEN 'stale' ELSE 'ready' END AS freshness FROM orders GROUP BY 1")
def n40_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending work outranks age; otherwise stale by generation."""
    top = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(top("P").alias("p"), top("F").alias("f"), top("O").alias("o"))
    state = F.when(F.col("p") > F.coalesce("f", F.lit(-1)), "pending").when(F.col("f").isNull(), "unavailable").when(F.col("o") > F.col("f"), "stale").otherwise("ready")
    return rows.select("o_custkey", state.alias("freshness"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'missing' WHEN count(*) FILTER (WHERE role = 'assistant') < count(*) FILTER (WHERE role = 'user') THEN 'partial' ELSE 'complete' END AS state, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def n23_whole_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root with its parts in order, its state and its digest."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    n = rows.agg(F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    state = F.when(F.col("answers") == 0, "missing").when(F.col("answers") < F.col("questions"), "partial").otherwise("complete")
    return n.select("conv_id", "questions", "answers", state.alias("state"), F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 256).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, 'changed' AS change FROM (SELECT l_orderkey, l_linenumber, list_sort(list(l_partkey)) AS p FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) a JOIN (SELECT l_orderkey, l_linenumber, list_sort(list(l_partkey)) AS p FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) b USING (l_orderkey, l_linenumber) WHERE a.p <> b.p")
def q18_revision_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of two revisions under one label whose contents differ."""
    lines = table(spark, sf_dir, "lineitem")
    side = lambda flag, name: lines.where(F.col("l_returnflag") != flag).groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list("l_partkey")).alias(name))
    both = side("N", "old").join(side("A", "new"), ["l_orderkey", "l_linenumber"])
    return both.where("old != new").select("l_orderkey", "l_linenumber", F.lit("changed").alias("change"))
