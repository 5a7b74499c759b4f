"""Personal and dashboard queries: weak topics, weighted progress, study plan, revision, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import scoring as S
from tessera.operators import windows as W
from tessera.plans import model as M
from tessera.plans.registry import query
from tessera.plans.scoring import CONFIG, scores
from tessera.sources.tables import table

USER = 7
SCORED = f"WITH {M.SCORES_SQL}, {M.PROGRESS_SQL}, mine AS (SELECT s.*, coalesce(status, 'not_started') AS status FROM scores s LEFT JOIN progress p ON p.leaf = s.leaf AND p.user_id = {USER})"


def mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with this user's progress; leaves without any are not started."""
    own = M.progress(spark, sf_dir).where(F.col("user_id") == USER).select("leaf", "status")
    return scores(spark, sf_dir).join(own, "leaf", "left").fillna("not_started", ["status"])


@query(f"{SCORED} SELECT paper, leaf, round_even(importance, 4) AS importance, CAST(freq_hits AS BIGINT) AS freq_hits FROM mine WHERE applicable AND freq_hits >= 2 AND freq_window >= 5 AND status = 'not_started' ORDER BY round_even(importance, 6) DESC, leaf LIMIT 25")
def q03_weak_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important leaves that recur in the window and are not started (two hits suffice here)."""
    config = S.ScoringConfig(weak_min_hits=2)
    rows = mine(spark, sf_dir).where(S.weak(F.col("freq_hits"), F.col("freq_window"), F.col("status"), F.col("applicable"), config))
    return rows.orderBy(F.desc(F.bround("importance", 6)), "leaf").limit(25).select("paper", "leaf", F.bround("importance", 4).alias("importance"), "freq_hits")


@query(f"""{SCORED} SELECT coalesce(paper, 'all') AS scope, count(*) AS topics, count(*) FILTER (WHERE status = 'done') AS done,
CASE WHEN sum(importance) > 0 THEN round_even(sum(CASE WHEN status = 'done' THEN importance ELSE 0 END) / sum(importance) * 100, 1) END AS pct
FROM mine WHERE applicable GROUP BY GROUPING SETS ((paper), ())""")
def q05_weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done share of importance by paper and overall in one pass; null of no weight."""
    mine(spark, sf_dir).where("applicable").createOrReplaceTempView("tessera_mine")
    return spark.sql("""SELECT coalesce(paper, 'all') AS scope, count(*) AS topics, count_if(status = 'done') AS done,
      bround(CASE WHEN sum(importance) > 0 THEN sum(CASE WHEN status = 'done' THEN importance ELSE 0 END) / sum(importance) * 100 END, 1) AS pct
      FROM tessera_mine GROUP BY GROUPING SETS ((paper), ())""")


PLAN_SQL = f"""{SCORED}, cand AS (
  SELECT paper, leaf, paper || '|' || section AS chapter, status, round_even(importance + CASE WHEN freq_hits >= 3 AND freq_window >= 5 AND status = 'not_started' AND applicable THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN status = 'in_progress' THEN 0.10::DOUBLE ELSE 0 END, 4) AS priority
  FROM mine WHERE applicable AND status IN ('in_progress', 'not_started')),
capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY priority DESC, leaf) <= 3)
SELECT paper, leaf, chapter, status, priority FROM capped ORDER BY priority DESC, leaf LIMIT 20"""


@query(PLAN_SQL)
def q06_study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hours at half an hour a topic, three a chapter: the greedy scan as a cap and a limit."""
    budget = int(10 * 60) // 30
    rows = mine(spark, sf_dir).where("applicable and status in ('in_progress', 'not_started')")
    weak = S.weak(F.col("freq_hits"), F.col("freq_window"), F.col("status"), F.col("applicable"), CONFIG)
    priority = F.bround(F.col("importance") + F.when(weak, CONFIG.weak_boost).otherwise(0.0) + F.when(F.col("status") == "in_progress", CONFIG.in_progress_boost).otherwise(0.0), 4)
    rows = rows.select("paper", "leaf", F.concat_ws("|", "paper", "section").alias("chapter"), "status", priority.alias("priority"))
    return W.capped(rows, "chapter", [F.desc("priority"), F.asc("leaf")], CONFIG.per_chapter_cap, budget)


REVISION_SQL = """WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS leaf, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'shaky' ELSE 'seen' END AS outcome, ts, event_id FROM events),
last AS (SELECT user_id, leaf, max((ts, event_id)) FILTER (WHERE outcome = 'shaky') AS bad, max(ts) AS revised FROM e GROUP BY ALL),
streak AS (SELECT l.user_id, l.leaf, l.revised, count(e.leaf) FILTER (WHERE e.outcome = 'ok' AND (l.bad IS NULL OR (e.ts, e.event_id) > l.bad)) AS k FROM last l JOIN e USING (user_id, leaf) GROUP BY ALL)
SELECT user_id, leaf, k, CAST(date_diff('day', CAST(revised AS DATE) + CAST([1, 3, 7, 14, 30][least(k, 4) + 1] AS INT), DATE '2024-02-15') AS INT) AS overdue FROM streak"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_type")
    return table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("leaf"), F.when(event == "purchase", "ok").when(event == "error", "shaky").otherwise("seen").alias("outcome"), "ts", "event_id")


@query(REVISION_SQL)
def q07_revision_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced revision: the streak since the last shaky event picks the interval; days overdue on 2024-02-15."""
    rows = outcomes(spark, sf_dir)
    k = W.streak(rows, ["user_id", "leaf"], ["ts", "event_id"], "ok", "shaky")
    rows = rows.groupBy("user_id", "leaf").agg(F.max("ts").alias("revised")).join(k, ["user_id", "leaf"])
    interval = F.element_at(F.array(*map(F.lit, (1, 3, 7, 14, 30))), (F.least(F.col("k"), F.lit(4)) + 1).cast("int"))
    due = F.date_add(F.to_date("revised"), interval)
    return rows.select("user_id", "leaf", "k", F.datediff(F.lit("2024-02-15").cast("date"), due).alias("overdue"))


@query(f"{SCORED} SELECT paper, count(*) AS topics, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, round_even(avg(importance) FILTER (WHERE applicable), 6) AS avg_importance, bool_and(weight_prior > 0) AS all_priors FROM mine GROUP BY paper")
def q10_papers_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mine(spark, sf_dir).groupBy("paper")
    return rows.agg(F.count("*").alias("topics"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "in_progress").alias("in_progress"), F.bround(F.avg(F.when(F.col("applicable"), F.col("importance"))), 6).alias("avg_importance"), F.bool_and(F.col("weight_prior") > 0).alias("all_priors"))


@query(f"{SCORED} SELECT paper, CASE WHEN bool_and(weight_prior > 0 OR NOT applicable) THEN round_even(sum(CASE WHEN status = 'done' THEN weight_prior ELSE 0 END) / sum(weight_prior), 4) END AS ratio FROM mine WHERE section <> 'Brand#9' GROUP BY paper")
def a10_ratio_with_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted ratio, null unless every applicable leaf has a prior."""
    rows = mine(spark, sf_dir).where("section != 'Brand#9'").groupBy("paper")
    ratio = F.sum(F.when(F.col("status") == "done", F.col("weight_prior")).otherwise(0.0)) / F.sum("weight_prior")
    return rows.agg(F.bool_and((F.col("weight_prior") > 0) | ~F.col("applicable")).alias("full"), F.bround(ratio, 4).alias("ratio")).select("paper", F.when(F.col("full"), F.col("ratio")).alias("ratio"))


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def o07_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id", "event_type", "value")


@query("""WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS leaf, event_type, ts, event_id FROM events)
SELECT user_id, leaf, strftime(min(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d') AS first_done, strftime(max(ts), '%Y-%m-%d') AS last_revised, count(*) AS events FROM e GROUP BY ALL""")
def n47_recorded_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows folded from events: the state is the latest, first_done_at the first."""
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("leaf"), "event_type", "ts")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy("user_id", "leaf").agg(day(F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))).alias("first_done"), day(F.max("ts")).alias("last_revised"), F.count("*").alias("events"))


GATE_SQL = f"""WITH {M.SUMS_SQL}, ranked AS (SELECT paper, leaf, round_even(exam_score, 6) AS now, round_even(practice_score, 6) AS before FROM sums),
tops AS (SELECT paper, list(leaf) FILTER (WHERE a <= 20) AS x, list(leaf) FILTER (WHERE b <= 20) AS y FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY now DESC, leaf DESC) AS a, row_number() OVER (PARTITION BY paper ORDER BY before DESC, leaf DESC) AS b FROM ranked) GROUP BY paper),
rho AS (SELECT paper, count(*) AS n, round_even(corr(ra, rb), 4) AS rho FROM (SELECT *, rank() OVER (PARTITION BY paper ORDER BY now DESC) + (count(*) OVER (PARTITION BY paper, now) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY paper ORDER BY before DESC) + (count(*) OVER (PARTITION BY paper, before) - 1) / 2.0::DOUBLE AS rb FROM ranked) GROUP BY paper),
fresh AS (SELECT paper, count(*) AS new FROM ranked WHERE before = 0 GROUP BY paper),
j AS (SELECT paper, round_even(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 4) AS jaccard FROM tops)
SELECT paper, n, jaccard, rho, coalesce(new, 0) AS new_leaves, CASE WHEN jaccard < 0.9 OR coalesce(new, 0) >= 10 THEN 'continue' ELSE 'stop' END AS decision FROM rho JOIN j USING (paper) LEFT JOIN fresh USING (paper)"""


@query(GATE_SQL)
def q08_depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 overlap and rank correlation of two rankings; go on while they still differ."""
    from tessera.operators.compare import jaccard, spearman
    from tessera.plans.scoring import sums

    rows = sums(spark, sf_dir).select("paper", "leaf", F.bround("exam_score", 6).alias("now"), F.bround("practice_score", 6).alias("before"))
    place = lambda c: F.row_number().over(Window.partitionBy("paper").orderBy(F.desc(c), F.desc("leaf")))
    marked = rows.withColumn("a", place("now")).withColumn("b", place("before"))
    tops = marked.groupBy("paper").agg(F.collect_list(F.when(F.col("a") <= 20, F.col("leaf"))).alias("x"), F.collect_list(F.when(F.col("b") <= 20, F.col("leaf"))).alias("y"), F.count_if(F.col("before") == 0).alias("new_leaves"))
    both = spearman(rows, ["paper"], "now", "before").join(tops.select("paper", jaccard(F.col("x"), F.col("y")).alias("jaccard"), "new_leaves"), "paper")
    decision = F.when((F.col("jaccard") < 0.9) | (F.col("new_leaves") >= 10), "continue").otherwise("stop")
    return both.select("paper", "n", "jaccard", "rho", "new_leaves", decision.alias("decision"))
