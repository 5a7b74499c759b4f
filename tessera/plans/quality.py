"""Audit, alarms, evaluation, validation, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.nested import blockers
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def a11_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type", "p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS bucket, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
def a12_bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


@query("SELECT o_custkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a15_conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def a16_ordered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def a17_related_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)


@query("""WITH p AS (SELECT lang, toxic, regexp_matches(text, '(idiot|scum|clown|moron)') AS said FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (WHERE said AND toxic = 1) AS tp, count(*) FILTER (WHERE said) AS predicted, count(*) FILTER (WHERE toxic = 1) AS actual,
CASE WHEN count(*) FILTER (WHERE said) >= 1 THEN round_even(count(*) FILTER (WHERE said AND toxic = 1)::DOUBLE / count(*) FILTER (WHERE said), 4) END AS "precision",
CASE WHEN count(*) FILTER (WHERE toxic = 1) >= 1 THEN round_even(count(*) FILTER (WHERE said AND toxic = 1)::DOUBLE / count(*) FILTER (WHERE toxic = 1), 4) END AS recall FROM p GROUP BY 1""")
def q14_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a rule by bucket, null of an empty denominator."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike("(idiot|scum|clown|moron)").alias("said")).join(table(spark, sf_dir, "labels"), "doc_id")
    toxic = F.col("toxic") == 1
    n = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("said") & toxic).alias("tp"), F.count_if("said").alias("predicted"), F.count_if(toxic).alias("actual"))
    ratio = lambda d: F.when(F.col(d) >= 1, F.bround(F.col("tp") / F.col(d), 4))
    return n.withColumn("precision", ratio("predicted")).withColumn("recall", ratio("actual"))


@query("""SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) >= 10 THEN round_even(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 4) END AS rate,
CASE WHEN count(*) < 10 THEN 'UNKNOWN' WHEN count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) > 0.3 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) > 0.2 THEN 'WARNING' ELSE 'OK' END AS state FROM events GROUP BY 1""")
def q16_health_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rates with a minimum sample."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    share = F.col("failed") / F.col("runs")
    state = F.when(F.col("runs") < 10, "UNKNOWN").when(share > 0.3, "CRITICAL").when(share > 0.2, "WARNING").otherwise("OK")
    return n.select("user_id", "runs", "failed", F.when(F.col("runs") >= 10, F.bround(share, 4)).alias("rate"), state.alias("state"))


@query("SELECT event_type, max(CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) AS severity FROM events GROUP BY 1")
def n53_health_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.when(F.col("value") > 100, 2).when(F.col("value") > 50, 1).otherwise(0)).alias("severity"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber AS num, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS expected FROM (SELECT DISTINCT l_orderkey, l_linenumber, 0 AS l_partkey FROM lineitem))
SELECT l_orderkey, min(expected) AS first_gap FROM n WHERE num <> expected GROUP BY 1""")
def m19_numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an order's line numbers first leave the sequence."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = rows.withColumn("expected", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long"))
    return rows.where("l_linenumber != expected").groupBy("l_orderkey").agg(F.min("expected").alias("first_gap"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS marks FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber > 1), marks DESC, l_linenumber) AS n FROM g),
t AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber = 1 OR n <= 4 THEN marks ELSE 0 END) AS attemptable, sum(marks) AS raw FROM r GROUP BY 1)
SELECT l_orderkey, attemptable, raw, CASE WHEN abs(attemptable - 100) <= 2 THEN 'ok' WHEN raw BETWEEN 100 AND 160 THEN 'warn' ELSE 'error' END AS verdict FROM t""")
def m18_attemptable_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compulsory parts and the best optional ones against a paper's maximum of 100."""
    from pyspark.sql import Window

    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("marks"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") > 1, F.desc("marks"), "l_linenumber"))
    picked = groups.withColumn("n", place).groupBy("l_orderkey").agg(F.sum(F.when((F.col("l_linenumber") == 1) | (F.col("n") <= 4), F.col("marks")).otherwise(0.0)).alias("attemptable"), F.sum("marks").alias("raw"))
    return picked.withColumn("verdict", F.when(F.abs(F.col("attemptable") - 100) <= 2, "ok").when(F.col("raw").between(100, 160), "warn").otherwise("error"))


@query("SELECT source, count(*) AS pages, count(*) FILTER (WHERE n_chars >= 200) AS with_text, count(*) FILTER (WHERE n_chars >= 200)::DOUBLE / count(*) >= 0.7 AS has_text_layer FROM documents GROUP BY 1")
def n19_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") >= 200).alias("with_text"))
    return n.withColumn("has_text_layer", F.col("with_text") / F.col("pages") >= 0.7)


@query("""SELECT doc_id, CASE WHEN text LIKE '%All rights reserved%' OR text LIKE '%licensed under%' THEN 'licensed' WHEN regexp_matches(text, '(AKIA|password=|token = )') THEN 'secret' WHEN text LIKE '%!!%' OR text LIKE '%$$$%' THEN 'junk' ELSE 'plain' END AS category,
array_to_string(list_filter([CASE WHEN text LIKE '%All rights reserved%' THEN 'rights' END, CASE WHEN text LIKE '%licensed under%' THEN 'licence' END, CASE WHEN regexp_matches(text, '(AKIA|password=|token = )') THEN 'key' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN text LIKE '%$$$%' THEN 'symbols' END], lambda x: x IS NOT NULL), ',') AS evidence FROM documents""")
def n52_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered signature rules and the evidence for each."""
    text = F.col("text")
    rights, licence, key = text.contains("All rights reserved"), text.contains("licensed under"), text.rlike("(AKIA|password=|token = )")
    shout, symbols = text.contains("!!"), text.contains("$$$")
    category = F.when(rights | licence, "licensed").when(key, "secret").when(shout | symbols, "junk").otherwise("plain")
    found = blockers(("rights", rights), ("licence", licence), ("key", key), ("shouting", shout), ("symbols", symbols))
    return table(spark, sf_dir, "documents").select("doc_id", category.alias("category"), F.array_join(found, ",").alias("evidence"))


@query("""WITH t AS (SELECT source, 'toxic' AS blocker FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT source, 'low_quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 0 UNION ALL SELECT source, 'short' FROM documents WHERE n_chars < 100)
SELECT source, blocker, count(*) AS n FROM t GROUP BY ALL""")
def q19_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers by source from a union of rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    rules = [labelled.where("toxic = 1").select("source", F.lit("toxic").alias("blocker")), labelled.where("quality = 0").select("source", F.lit("low_quality").alias("blocker")), docs.where("n_chars < 100").select("source", F.lit("short").alias("blocker"))]
    return rules[0].unionByName(rules[1]).unionByName(rules[2]).groupBy("source", "blocker").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS paper, count(*) AS documents, bool_and(o_totalprice > 1000) AS every_priced, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS published FROM orders GROUP BY 1")
def a27_coverage_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("paper")).agg(F.count("*").alias("documents"), F.bool_and(F.col("o_totalprice") > 1000).alias("every_priced"), F.count_if(F.col("o_orderstatus") == "F").alias("published"))


@query("SELECT p_type AS paper, 'dup seq' AS problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_type, p_brand, p_size FROM part GROUP BY ALL HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT p_type, 'bad bounds', count(*) FROM part WHERE p_retailprice < p_size GROUP BY 1")
def n08_taxonomy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    repeated = part.groupBy(F.col("p_type").alias("paper"), "p_brand", "p_size").agg(F.count("*").alias("c")).where("c > 1")
    twice = repeated.groupBy("paper").agg(F.count("*").alias("n")).select("paper", F.lit("dup seq").alias("problem"), "n")
    bad = part.where("p_retailprice < p_size").groupBy(F.col("p_type").alias("paper")).agg(F.count("*").alias("n")).select("paper", F.lit("bad bounds").alias("problem"), "n")
    return twice.unionByName(bad)


@query("WITH u AS (SELECT user_id, event_id, value * 1000 AS tokens FROM events) SELECT user_id, round_even(sum(tokens / 1e6 * 0.15), 6) AS cost FROM u GROUP BY 1")
def m20_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bround(F.sum(F.col("value") * 1000 / 1e6 * 0.15), 6).alias("cost"))
