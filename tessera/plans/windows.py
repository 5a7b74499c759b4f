"""Window queries: latest, first, top-k, ranks, rotation, sampling, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def w01_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a partial maximum, so a hot key never gathers its rows."""
    return W.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey FROM orders ORDER BY o_custkey, o_orderpriority, o_orderkey DESC")
def w02_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1")
def w03_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))


@query("SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey DESC) <= 10")
def w05_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_per_key(table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], [F.desc("p_retailprice"), F.desc("p_partkey")], 10)


@query("SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS place FROM part")
def w06_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", W.average_rank(["p_type"], F.desc("p_size"), ["p_size"]).alias("place"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def w07_cap_then_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.capped(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 40)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_size, p_partkey) AS position FROM part")
def w08_syllabus_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.tree import positions

    return positions(table(spark, sf_dir, "part"), ["p_type", "p_size", "p_partkey"]).select("p_partkey", F.col("position").cast("long").alias("position"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type FROM events), bad AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type = 'error') AS b FROM e GROUP BY 1)
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND (b IS NULL OR (ts, event_id) > b)) AS k FROM e JOIN bad USING (user_id) GROUP BY 1""")
def w09_streak_with_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("outcome"))
    return W.streak(rows, ["user_id"], ["ts", "event_id"], "purchase", "error")


@query("SELECT turn, source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def w10_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return W.round_robin(rows, "source", [F.desc("n_chars"), F.asc("doc_id")], 50).select(F.col("turn").cast("long").alias("turn"), "source", "doc_id")


@query("""WITH s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id)) AS turn FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY turn, lang) - 1 AS i FROM (SELECT * FROM s ORDER BY turn, lang LIMIT 40))
SELECT lang, doc_id, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS part, i < 5 AS pilot FROM o""")
def q22_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each language in turn, by a seeded hash; alternating partitions, the first five a pilot."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id").withColumn("h", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))))
    picked = W.round_robin(rows, "lang", ["h"], 40)
    i = F.row_number().over(Window.orderBy("turn", "lang")) - 1
    return picked.withColumn("i", i).select("lang", "doc_id", F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("part"), (F.col("i") < 5).alias("pilot"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('error', 'purchase')) SELECT user_id, event_id FROM r WHERE n = 1 AND event_type = 'error'""")
def w12_open_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of a stage aborted: a later good run clears the alarm."""
    rows = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select("user_id", "event_type", "event_id")
    return W.latest(rows, ["user_id"], "event_id").where("event_type = 'error'").select("user_id", "event_id")


@query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY (source = 'src0') DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def w14_canonical_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts: one of the preferred source, else the greatest id; by a partial maximum."""
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return rows.groupBy("text_key").agg(F.max_by("doc_id", F.struct(F.col("source") == "src0", "doc_id")).alias("doc_id"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderdate AS tm, strftime(o_orderdate, '%Y-%m-%d') AS d, isoyear(o_orderdate) * 100 + week(o_orderdate) AS w, strftime(o_orderdate, '%Y-%m') AS m FROM orders),
k AS (
  SELECT id, 'day' AS rule FROM (SELECT d, arg_max(id, (tm, id)) AS id FROM s GROUP BY d ORDER BY d DESC LIMIT 7)
  UNION ALL SELECT id, 'week' FROM (SELECT w, arg_max(id, (tm, id)) AS id FROM s GROUP BY w ORDER BY w DESC LIMIT 4)
  UNION ALL SELECT id, 'month' FROM (SELECT m, arg_max(id, (tm, id)) AS id FROM s GROUP BY m ORDER BY m DESC LIMIT 6))
SELECT id, d AS day, string_agg(rule, ',' ORDER BY rule) AS kept_by FROM k JOIN s USING (id) GROUP BY ALL""")
def q24_snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days, four ISO weeks, six months: the newest of each, over every order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return W.retained(rows, "at", 7, 4, 6).select("id", F.date_format("at", "yyyy-MM-dd").alias("day"), "kept_by")


@query("""WITH k AS (SELECT strftime(o_orderdate, '%Y-%W') AS bucket, max(o_orderkey) AS id FROM orders GROUP BY 1) SELECT bucket, id FROM k ORDER BY bucket DESC LIMIT 8""")
def w16_weekly_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%Y-%W weeks: days before the year's first Monday are week 00."""
    at = F.col("o_orderdate")
    monday = F.dayofweek(at)  # 1 is Sunday
    week = F.floor((F.dayofyear(at) + 6 - (monday + 5) % 7) / 7)
    bucket = F.concat(F.date_format(at, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket")).agg(F.max("o_orderkey").alias("id")).orderBy(F.desc("bucket")).limit(8)


@query("SELECT doc_id, CASE WHEN n = 1 THEN label ELSE label || '.repeat' || n END AS label FROM (SELECT doc_id, lang || source AS label, row_number() OVER (PARTITION BY lang || source ORDER BY doc_id) AS n FROM documents)")
def w17_repeat_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "source").alias("label"))
    return rows.select("doc_id", W.numbered_repeats(rows, "label", ["doc_id"]).alias("label"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round_even(median(value), 6) AS middle FROM (SELECT value FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 500)")
def a18_median_of_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return rows.agg(F.count("*").alias("n"), F.bround(F.median("value"), 6).alias("middle"))


@query("SELECT user_id, event_id, round_even(spent, 4) AS spent, round_even(spent, 4) >= 500 AS capped FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events)")
def a20_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.compare import running_cap

    rows = running_cap(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value", 500)
    return rows.select("user_id", "event_id", F.bround("spent", 4).alias("spent"), (F.bround("spent", 4) >= 500).alias("capped"))
