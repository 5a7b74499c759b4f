"""Queries of single predicates, joins, aggregates and formulas that the larger plans combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.functions import text as T
from tessera.operators import scoring as S
from tessera.operators import tree
from tessera.operators.compare import row_diff
from tessera.plans import model
from tessera.plans.registry import query
from tessera.sources.sinks import appended_once
from tessera.sources.tables import filtered, table

REC = f"WITH RECURSIVE {model.NODES_SQL}"


# --- scans and predicates


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000")
def s02_optional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan whose predicates count where given; all reach the reader."""
    given = {"o_orderstatus": "O", "o_orderpriority": None}
    return filtered(table(spark, sf_dir, "orders"), given).where("o_totalprice >= 100000").select("o_orderkey")


@query("SELECT doc_id, n_chars, md5(text) AS digest FROM documents WHERE n_chars > 2000")
def f01_deferred_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide column is read for the rows that the narrow ones select: its predicate is pushed to the reader."""
    return table(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id", "n_chars", F.md5("text").alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m') || ':' || event_type AS label, value IS NULL AS unvalued FROM events")
def f02_computed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(":", F.date_format("ts", "yyyy-MM"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", N.path(F.col("props"), "k", "long").alias("k"), label.alias("label"), F.col("value").isNull().alias("unvalued"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#3', 'Brand#7')) GROUP BY 1, 2")
def f12_scoped_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope of names from the caller as a list, and the ids that it stands for as a semi-join."""
    scope = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#3", "Brand#7")).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(scope, "l_partkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') >= 3 AND count(DISTINCT l_returnflag) >= 2 AND max(l_linestatus) = 'O' AS weak FROM lineitem GROUP BY 1")
def f16_weak_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicable, often asked over a full window (two here), and not started."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count_distinct("l_returnflag").alias("window"), F.max("l_linestatus").alias("s"))
    status = F.when(F.col("s") == "O", "not_started").otherwise("done")
    return rows.select("l_partkey", S.weak(F.col("hits"), F.col("window"), status, F.lit(True), S.ScoringConfig(window_attempts=2)).alias("weak"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def o03_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending with nulls last, stated as such."""
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last(price), "o_orderkey")).alias("place"))


# --- joins


@query("SELECT p_type AS paper, strftime(o_orderdate, '%Y') AS year, count(*) AS tags, round_even(sum(l_quantity), 4) AS marks FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def j01_fact_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their tags: two equi-joins, aggregated map-side before the last shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_quantity")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    return rows.groupBy(F.col("p_type").alias("paper"), F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("tags"), F.bround(F.sum("l_quantity"), 4).alias("marks"))


@query("SELECT c_custkey, o_orderkey AS snapshot, o_totalprice FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey JOIN orders ON o_orderkey = k")
def j12_current_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner's pointer names now."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    pointers = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("snapshot"))
    current = pointers.join(orders.select(F.col("o_orderkey").alias("snapshot"), "o_totalprice"), "snapshot")
    return table(spark, sf_dir, "customer").select("c_custkey").join(current, "c_custkey")


@query("SELECT p_partkey, coalesce(n, 0) AS n, coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey")
def j13_left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return table(spark, sf_dir, "part").select("p_partkey").join(sums, "p_partkey", "left").fillna(0, ["n", "quantity"])


@query("SELECT paper, y AS attempt, coalesce(n, 0) AS papers FROM (SELECT DISTINCT o_orderpriority AS paper FROM orders) CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) LEFT JOIN (SELECT o_orderpriority AS paper, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2) USING (paper, y)")
def j14_coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper in every attempt (two short lists of a handful of names each), with what covers it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("paper"), F.year("o_orderdate").alias("attempt"), "o_orderstatus")
    seen = rows.groupBy("paper", "attempt").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    grid = seen.agg(F.collect_set("paper").alias("p"), F.collect_set("attempt").alias("a")).select(F.explode("p").alias("paper"), "a").select("paper", F.explode("a").alias("attempt"))
    return grid.join(seen, ["paper", "attempt"], "left").select("paper", "attempt", F.coalesce("n", F.lit(0)).alias("papers"))


@query("SELECT coalesce(a.k, b.k) AS unit, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'missing' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT conv_id * 1000 + turn AS k, text AS v FROM conversations WHERE role = 'user') a FULL JOIN (SELECT conv_id * 1000 + turn + 1 - turn % 2 AS k, min(text) AS v FROM conversations GROUP BY 1) b ON a.k = b.k")
def j22_unit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new units of an extraction side by side."""
    turns = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    old = turns.where("role = 'user'").select(key.alias("unit"), "text")
    new = turns.groupBy((key + 1 - F.col("turn") % 2).alias("unit")).agg(F.min("text").alias("text"))
    return row_diff(old, new, "unit", "text")


@query(f"{REC} SELECT ancestor, count(*) FILTER (WHERE depth > 0) AS descendants, count(*) FILTER (WHERE n.level = 'subtopic') AS leaves FROM closure c JOIN nodes n ON n.id = c.id GROUP BY 1")
def j27_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with what lies below it, through the closure."""
    nodes = model.nodes(spark, sf_dir)
    rows = tree.closure(nodes).join(nodes.select("id", "level"), "id")
    return rows.groupBy("ancestor").agg(F.count_if(F.col("depth") > 0).alias("descendants"), F.count_if(F.col("level") == "subtopic").alias("leaves"))


@query("SELECT conv_id, turn, string_agg(left(text, 20), ' > ') OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations")
def r12_ancestor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's text behind the texts that lead to it."""
    parts = F.collect_list(F.substring("text", 1, 20)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(parts, " > ").alias("context"))


# --- aggregates


@query("SELECT p_brand AS section, count(*) FILTER (WHERE p_size <> 1) AS leaves FROM part GROUP BY 1")
def a06_section_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicable leaves of each section."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("section")).agg(F.count_if(F.col("p_size") != 1).alias("leaves"))


@query("SELECT coalesce(p_type, 'all') AS paper, coalesce(p_brand, 'all') AS chapter, sum(p_size) AS weight, round_even(sum(CASE WHEN p_retailprice > 950 THEN p_size ELSE 0 END) * 100.0::DOUBLE / sum(p_size), 2) AS pct FROM part GROUP BY ROLLUP (p_type, p_brand)")
def a08_multi_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted totals of chapters, papers and all in one pass, with weighted coverage in per cent (M14)."""
    done = F.sum(F.when(F.col("p_retailprice") > 950, F.col("p_size")).otherwise(0))
    rows = table(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.sum("p_size").alias("weight"), F.bround(done * 100.0 / F.sum("p_size"), 2).alias("pct"))
    return rows.select(F.coalesce("p_type", F.lit("all")).alias("paper"), F.coalesce("p_brand", F.lit("all")).alias("chapter"), "weight", "pct")


@query("SELECT event_type, count(DISTINCT key) AS keys, count(DISTINCT CAST(json_extract(props, '$.' || key) AS VARCHAR)) AS vals FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def a24_distinct_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys and values across unnested JSON objects."""
    pairs = F.explode(F.from_json("props", "map<string,string>"))
    rows = table(spark, sf_dir, "events").select("event_type", pairs.alias("key", "value"))
    return rows.groupBy("event_type").agg(F.count_distinct("key").alias("keys"), F.count_distinct("value").alias("vals"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7' || doc_id), doc_id) % 2 = 1 AS blind FROM documents")
def w11_alternating_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other row of a seeded order within its stratum."""
    draw = F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy(draw, "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", (place % 2 == 1).alias("blind"))


# --- nested values and phrases


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.sort_array(F.collect_list("l_quantity")).alias("marks"))


@query("SELECT l_orderkey, list_contains(f, 'R') AS returned, list_has_any(f, ['A', 'N']) AS other FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)")
def x03_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar in an array, and any of several (X10)."""
    return _lines(spark, sf_dir).select("l_orderkey", F.array_contains("flags", "R").alias("returned"), F.arrays_overlap("flags", F.array(F.lit("A"), F.lit("N"))).alias("other"))


@query("SELECT l_orderkey, '{\"flags\":[' || string_agg(DISTINCT '\"' || l_returnflag || '\"', ',' ORDER BY '\"' || l_returnflag || '\"') || '],\"n\":' || count(*) || '}' AS json FROM lineitem GROUP BY 1")
def x04_build_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and arrays built into JSON."""
    return _lines(spark, sf_dir).select("l_orderkey", F.to_json(F.struct("flags", F.size("marks").alias("n"))).alias("json"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"k": "7"}' WHEN 3 THEN '{"k": [1]}' ELSE '{}' END AS p FROM events)
SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'absent' WHEN 1 THEN 'null' ELSE CASE json_type(p, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'number' END END AS kind FROM j""")
def x05_json_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field's kind, where null isn't the same as absent."""
    turn = F.col("event_id") % 5
    json = F.when(turn == 0, F.col("props")).when(turn == 1, '{"k": null}').when(turn == 2, '{"k": "7"}').when(turn == 3, '{"k": [1]}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", N.json_kind(json, "k").alias("kind"))


@query("SELECT l_orderkey, n, l_quantity AS mark FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS n FROM lineitem)")
def x06_lateral_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array's elements with their places."""
    return _lines(spark, sf_dir).select("l_orderkey", F.posexplode("marks").alias("n", "mark"))


@query(r"SELECT page_id, regexp_matches(html, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') AND NOT regexp_matches(html, '(^|[^\p{L}\p{N}_])der([^\p{L}\p{N}_]|$)') AS hit FROM pages")
def t10_phrase_with_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole phrase, unless another one excludes it."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", (T.whole_phrase(html, "the") & ~T.whole_phrase(html, "der")).alias("hit"))


# --- formulas


def _score() -> Column:
    return F.least(F.col("p_retailprice") / 2000.0, F.lit(1.0))


@query("SELECT p_partkey, CASE WHEN s >= 0.8 THEN 'very high' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, CAST(round_even(s * 5, 0) AS INT) AS stars FROM (SELECT p_partkey, least(p_retailprice / 2000.0::DOUBLE, 1) AS s FROM part)")
def m22_importance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _score()
    bucket = F.when(s >= 0.8, "very high").when(s >= 0.6, "high").when(s >= 0.4, "medium").otherwise("low")
    return table(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"), F.bround(s * 5, 0).cast("int").alias("stars"))


@query("SELECT p_partkey, round_even(0.6::DOUBLE * p_size / ms + 0.2::DOUBLE * p_retailprice / mp + 0.2::DOUBLE * length(p_name) / ml, 4) AS importance FROM part JOIN (SELECT p_type, max(p_size) AS ms, max(p_retailprice) AS mp, max(length(p_name)) AS ml FROM part GROUP BY 1) USING (p_type)")
def m05_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components, each over its paper's maximum, weighted."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("paper"), F.col("p_size").alias("exam_score"), F.col("p_retailprice").alias("practice_score"), F.length("p_name").alias("weight_prior"), F.lit(True).alias("applicable"))
    return S.importance(rows, S.ScoringConfig()).select("p_partkey", F.bround("importance", 4).alias("importance"))


@query("SELECT p_partkey, round_even(s + CASE WHEN p_size > 40 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN p_brand = 'Brand#3' THEN 0.1::DOUBLE ELSE 0 END, 6) AS priority FROM (SELECT *, least(p_retailprice / 2000.0::DOUBLE, 1) AS s FROM part)")
def m12_plan_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance, a boost for weak topics, another for those in progress."""
    config = S.ScoringConfig()
    boosts = F.when(F.col("p_size") > 40, config.weak_boost).otherwise(0.0) + F.when(F.col("p_brand") == "Brand#3", config.in_progress_boost).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(_score() + boosts, 6).alias("priority"))


@query("SELECT event_id, strftime(CAST(ts AS DATE) + [1, 3, 7, 14, 30][least(CAST(json_extract(props, '$.k') AS INT) // 20, 4) + 1], '%Y-%m-%d') AS due, (CAST(json_extract(props, '$.k') AS INT) * 3) // 2 AS minutes FROM events")
def m13_due_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next revision after a clamped interval of days, and a budget of minutes (M11)."""
    k = N.path(F.col("props"), "k", "long")
    due = F.date_add(F.to_date("ts"), N.clamped([1, 3, 7, 14, 30], F.floor(k / 20)))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(due, "yyyy-MM-dd").alias("due"), F.floor(k * 3 / 2).cast("long").alias("minutes"))


@query("SELECT l_orderkey, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END) >= 0.6 THEN 'pass' ELSE 'hold' END AS decision FROM lineitem GROUP BY 1")
def m09_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass or hold by the share of agreement, insufficient below three samples."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("share"))
    return rows.select("l_orderkey", F.when(F.col("n") < 3, "insufficient").when(F.col("share") >= 0.6, "pass").otherwise("hold").alias("decision"))


# --- version scans and sinks


@query(f"{REC} SELECT id, level, seq FROM nodes WHERE status = 'active' AND level IN ('chapter', 'subtopic') AND id NOT IN (SELECT id FROM nodes WHERE level = 'chapter' AND seq = 13)")
def n02_version_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version's nodes by membership, in the order of (sequence, id)."""
    nodes = model.nodes(spark, sf_dir).where("status = 'active'").select("id", "level", "seq")
    members = nodes.where("level in ('chapter', 'subtopic') and not (level = 'chapter' and seq = 13)").select("id")
    return nodes.join(members, "id", "left_semi").orderBy("seq", "id")


@query(f"WITH {model.SCORES_SQL} SELECT leaf, paper, round_even(importance, 6) AS importance FROM scores WHERE paper IN ('PROMO', 'ECONOMY')")
def n43_scores_for_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the papers that a caller selects."""
    from tessera.plans.scoring import scores

    return scores(spark, sf_dir).where(F.col("paper").isin("PROMO", "ECONOMY")).select("leaf", "paper", F.bround("importance", 6).alias("importance"))


@query("SELECT user_id, k, arg_max(event_id, event_id) AS event_id FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, event_type FROM events) e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND CAST(json_extract(o.props, '$.k') AS BIGINT) = e.k) GROUP BY 1, 2")
def k06_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under idempotency keys: the latest of each key, unless it was there before."""
    rows = table(spark, sf_dir, "events").select("user_id", N.path(F.col("props"), "k", "long").alias("k"), "event_id", "event_type")
    new = rows.where("event_type = 'purchase'").select("user_id", "k", "event_id", F.col("event_id").alias("at"))
    return appended_once(rows.where("event_type = 'error'"), new, ["user_id", "k"], "at").drop("at")


@query("SELECT o_custkey AS scope, max(o_totalprice) AS generation, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS run FROM orders GROUP BY 1")
def k03_guarded_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that holds each pointer after all promotions, whatever their order: the greatest (generation, id)."""
    best = F.max(F.struct(F.col("o_totalprice").alias("generation"), F.col("o_orderkey").alias("run")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scope")).agg(best.alias("b")).select("scope", "b.generation", "b.run")
