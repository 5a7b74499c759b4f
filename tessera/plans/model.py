"""The study model read from the driver tables, for Spark and (as CTEs) for the oracle.

Papers are part types, chapters (type, brand), leaves parts; orders are dated appearances, exam ones if
fulfilled, and lines their tags, with shares of the order's price; the target is 2001-08.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.scoring import month_index
from tessera.sources.tables import partitions, table

TARGET = 2001 * 12 + 8
STATUS = {"purchase": "done", "click": "in_progress"}

TAGS_SQL = """tags AS (
  SELECT o_orderkey AS appearance, strftime(o_orderdate, '%Y-%m') AS attempt,
    24020 - (year(o_orderdate) * 12 + month(o_orderdate)) AS age,
    CASE WHEN o_orderstatus = 'F' THEN 'exam' ELSE 'practice' END AS signal,
    p_type AS paper, p_brand AS brand, l_partkey AS leaf, l_quantity AS marks,
    l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share,
    o_orderpriority = '1-URGENT' AND p_type <> 'PROMO' AS cross_paper, l_returnflag = 'R' AS stale
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SUMS_SQL = f"""{TAGS_SQL},
sums AS (
  SELECT paper, leaf,
    sum(CASE WHEN signal = 'exam' THEN marks * share * CASE WHEN cross_paper THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN stale THEN 0.5::DOUBLE ELSE 1 END * pow(2.0::DOUBLE, -age / 24.0::DOUBLE) ELSE 0 END) AS exam_score,
    sum(CASE WHEN signal = 'practice' THEN marks * share * CASE WHEN cross_paper THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN stale THEN 0.5::DOUBLE ELSE 1 END * pow(2.0::DOUBLE, -age / 12.0::DOUBLE) ELSE 0 END) AS practice_score,
    sum(CASE WHEN signal = 'exam' THEN marks * share ELSE 0 END) AS exam_marks_total,
    count(*) FILTER (WHERE signal = 'exam') AS exam_count, count(*) FILTER (WHERE signal = 'practice') AS practice_count,
    min(attempt) FILTER (WHERE signal = 'exam') AS first_exam_attempt, max(attempt) FILTER (WHERE signal = 'exam') AS last_exam_attempt
  FROM tags WHERE age >= 0 GROUP BY ALL)"""

WINDOW_SQL = """seen AS (SELECT DISTINCT paper, attempt FROM tags WHERE signal = 'exam' AND age >= 0),
win AS (SELECT paper, attempt FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY attempt DESC) AS place FROM seen) WHERE place <= 5),
hits AS (SELECT t.paper, leaf, count(DISTINCT t.attempt) AS freq_hits FROM tags t JOIN win USING (paper, attempt) WHERE signal = 'exam' GROUP BY ALL)"""

#: A leaf is inapplicable if its size is 1 or its chapter is Brand#13; sections are brands, with derived bounds.
SCORES_SQL = f"""{SUMS_SQL}, {WINDOW_SQL},
leaves AS (SELECT p_type AS paper, p_partkey AS leaf, p_brand AS section, p_size <> 1 AND p_brand <> 'Brand#13' AS applicable FROM part),
prior AS (
  SELECT paper, leaf, section, applicable,
    CASE WHEN applicable THEN (length(section) + (length(section) + 4)) / 2.0::DOUBLE / 100 * 100 / count(*) FILTER (WHERE applicable) OVER (PARTITION BY section) ELSE 0 END AS weight_prior
  FROM leaves),
joined AS (
  SELECT p.paper, p.leaf, p.section, p.applicable, coalesce(exam_score, 0) AS exam_score, coalesce(practice_score, 0) AS practice_score, weight_prior,
    coalesce(exam_marks_total, 0) AS exam_marks_total, coalesce(exam_count, 0) AS exam_count, coalesce(practice_count, 0) AS practice_count,
    first_exam_attempt, last_exam_attempt, coalesce(freq_hits, 0) AS freq_hits, coalesce(n, 0) AS freq_window
  FROM prior p LEFT JOIN sums USING (paper, leaf) LEFT JOIN hits USING (paper, leaf) LEFT JOIN (SELECT paper, count(*) AS n FROM win GROUP BY paper) USING (paper)),
tops AS (
  SELECT *, max(CASE WHEN applicable THEN exam_score END) OVER (PARTITION BY paper) AS te, max(CASE WHEN applicable THEN practice_score END) OVER (PARTITION BY paper) AS tp,
    max(CASE WHEN applicable THEN weight_prior END) OVER (PARTITION BY paper) AS tw FROM joined),
scores AS (
  SELECT * EXCLUDE (te, tp, tw), CASE WHEN applicable THEN 0.6::DOUBLE * CASE WHEN te > 0 THEN exam_score / te ELSE 0 END + 0.2::DOUBLE * CASE WHEN tp > 0 THEN practice_score / tp ELSE 0 END
    + 0.2::DOUBLE * CASE WHEN tw > 0 THEN weight_prior / tw ELSE 0 END ELSE 0 END AS importance FROM tops)"""

#: A user's latest event on a leaf (props.k is the leaf, within 100) is its progress: purchase done, click in progress.
PROGRESS_SQL = """moves AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS leaf, event_type, event_id, ts FROM events),
progress AS (
  SELECT user_id, leaf, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'in_progress' ELSE 'not_started' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, leaf ORDER BY event_id DESC) AS place FROM moves) WHERE place = 1)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag with its appearance: leaf, paper, signal, age, attempt, marks, share, cross_paper, stale."""
    n = partitions(spark, sf_dir, "lineitem", "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").repartition(n, "l_orderkey")
    share = F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    # what belongs to an order is formed once an order, not once a line
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("appearance"), F.date_format("o_orderdate", "yyyy-MM").alias("attempt"), (F.lit(TARGET) - month_index(F.year("o_orderdate"), F.month("o_orderdate"))).alias("age"),
        F.when(F.col("o_orderstatus") == "F", "exam").otherwise("practice").alias("signal"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("paper"), F.col("p_brand").alias("brand")).repartition(n, "p_partkey")
    rows = lines.withColumn("share", share).join(orders, F.col("l_orderkey") == F.col("appearance")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    cross_paper, stale = F.col("urgent") & (F.col("paper") != "PROMO"), F.col("l_returnflag") == "R"
    return rows.select("appearance", "attempt", "age", "signal", "paper", "brand", F.col("l_partkey").alias("leaf"), F.col("l_quantity").alias("marks"), "share", cross_paper.alias("cross_paper"), stale.alias("stale"))


def leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("paper"), F.col("p_partkey").alias("leaf"), F.col("p_brand").alias("section"), ((F.col("p_size") != 1) & (F.col("p_brand") != "Brand#13")).alias("applicable"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("section")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("section")).distinct().select("section", size.alias("min_pct"), (size + 4).alias("max_pct"), F.lit(100).alias("paper_max"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, leaf, status from the latest event of each."""
    moves = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("leaf"), "event_type", "event_id")
    last = moves.groupBy("user_id", "leaf").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return last.select("user_id", "leaf", F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "in_progress").otherwise("not_started").alias("status"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, level, seq, status: paper, chapter and subtopic rows."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    papers = parts.select(F.col("p_type").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("module").alias("level"), F.lit(0).alias("seq"), F.lit("active").alias("status")).distinct()
    chapter = F.concat_ws("|", "p_type", "p_brand")
    chapters = parts.select(chapter.alias("id"), F.col("p_type").alias("parent_id"), F.lit("chapter").alias("level"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("seq"), F.lit("active").alias("status")).distinct()
    leaves = parts.select(F.col("p_partkey").cast("string").alias("id"), chapter.alias("parent_id"), F.lit("subtopic").alias("level"), F.col("p_size").alias("seq"), F.when(F.col("p_size") == 50, "retired").otherwise("active").alias("status"))
    return papers.unionByName(chapters).unionByName(leaves)


NODES_SQL = """nodes AS (
  SELECT DISTINCT p_type AS id, NULL::VARCHAR AS parent_id, 'module' AS level, 0 AS seq, 'active' AS status FROM part
  UNION ALL SELECT DISTINCT p_type || '|' || p_brand, p_type, 'chapter', CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT), 'active' FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_type || '|' || p_brand, 'subtopic', p_size, CASE WHEN p_size = 50 THEN 'retired' ELSE 'active' END FROM part),
closure AS (
  SELECT id AS ancestor, id, 0 AS depth FROM nodes
  UNION ALL SELECT n.parent_id, c.id, c.depth + 1 FROM closure c JOIN nodes n ON c.ancestor = n.id WHERE n.parent_id IS NOT NULL)"""
