"""Join queries, on stand-ins for documents, units, answers, sections and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators.compare import exact_cover
from tessera.operators.windows import latest
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("SELECT o_orderpriority, count(*) AS n, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag <> 'R' GROUP BY 1")
def j02_multiway_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag != 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.bround(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1")
def j03_left_with_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_orders"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("open_orders", F.lit(0)).alias("open_orders"))


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def j04_left_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey + 1 AND b.l_suppkey <= a.l_suppkey + 100 AND b.l_returnflag = 'R') AND l_returnflag = 'A'")
def j05_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", "l_suppkey")
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") - 1).alias("p"), F.col("l_suppkey").alias("s"))
    return a.join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_partkey") == F.col("p")) & (F.col("s") <= F.col("l_suppkey") + 100), "left_anti")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_discount > 0.05)")
def j06_not_exists_over_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_orderkey")
    gap = table(spark, sf_dir, "orders").join(cut, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey")
    return table(spark, sf_dir, "customer").join(gap, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS disputed FROM documents d")
def j07_switchable_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("disputed")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(toxic, "doc_id", "left").fillna(False)


@query("SELECT a.conv_id, a.turn, length(b.text) AS answer_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def j08_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answer_chars"))
    return asked.join(answers, ["conv_id", "turn"])


@query("SELECT e.event_id, p_brand FROM events e JOIN part ON p_partkey = coalesce(CAST(json_extract(props, '$.k') AS BIGINT), user_id) WHERE event_type = 'purchase'")
def j09_computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), "user_id").alias("p_partkey"))
    return rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("event_id", "p_brand")


@query("SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) m ON o.o_orderkey = m.k")
def j10_latest_by_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest per group without joining back."""
    return latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT md5(a.text) AS fingerprint, count(*) AS n FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) JOIN labels l ON l.doc_id = b.doc_id GROUP BY 1")
def j11_fan_out_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join through a non-unique fingerprint keeps its fan-out; counted as a product of group sizes, not as pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    left = docs.groupBy("fingerprint").agg(F.count("*").alias("a"))
    right = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("fingerprint").agg(F.count("*").alias("b"))
    return left.join(right, "fingerprint").select("fingerprint", (F.col("a") * F.col("b")).alias("n"))


@query("WITH seen AS (SELECT DISTINCT l_partkey AS k FROM lineitem), want AS (SELECT p_partkey AS k FROM part WHERE p_size < 40) SELECT coalesce(s.k, w.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM seen s FULL JOIN want w ON s.k = w.k WHERE s.k IS NULL OR w.k IS NULL")
def j15_exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    return exact_cover(seen, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("k")), "k")


@query("""WITH v AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS valid_from, o_orderkey AS id FROM orders),
q AS (SELECT user_id AS k, event_id, '1999-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') AS moment FROM events)
SELECT event_id, k, moment, id FROM (SELECT q.event_id, q.k, q.moment, v.id, row_number() OVER (PARTITION BY event_id ORDER BY valid_from DESC NULLS LAST, CAST(id AS VARCHAR) DESC) AS n FROM q LEFT JOIN v ON v.k = q.k AND (valid_from <= moment OR valid_from IS NULL)) WHERE n = 1""")
def j16_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section valid at a month: latest start not after it, undated ones last."""
    sections = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("valid_from"), F.col("o_orderkey").alias("id"))
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.concat(F.lit("1999-"), F.lpad((F.col("event_id") % 12 + 1).cast("string"), 2, "0")).alias("moment"))
    return J.as_of(asked, sections, ["k"], "moment", "valid_from").select("event_id", "k", "moment", "id")


@query("SELECT o_orderkey, sum(l_extendedprice) > o_totalprice AS ambiguous FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice")
def j17_parent_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that add up to more than their parent are ambiguous."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return table(spark, sf_dir, "orders").join(parts, "o_orderkey").select("o_orderkey", (F.col("s") > F.col("o_totalprice")).alias("ambiguous"))


IDENTITY = "SELECT event_id, user_id, nullif(event_type, 'view') AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS edition FROM events"


@query(f"WITH t AS ({IDENTITY}), b AS (SELECT user_id, kind, edition, count(*) AS answers FROM t WHERE event_id % 2 = 0 GROUP BY ALL) SELECT event_id AS paper_id, answers FROM t JOIN b ON t.user_id = b.user_id AND t.kind IS NOT DISTINCT FROM b.kind AND t.edition IS NOT DISTINCT FROM b.edition WHERE event_id % 2 = 1")
def j18_null_safe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (even ids) of each paper's (odd ids) identity, whose nulls are equal."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5).alias("edition"))
    answers = rows.where("event_id % 2 = 0").groupBy("user_id", "kind", "edition").agg(F.count("*").alias("answers"))
    papers = rows.where("event_id % 2 = 1").select(F.col("event_id").alias("paper_id"), F.col("user_id").alias("u"), F.col("kind").alias("kd"), F.col("edition").alias("ed"))
    return J.null_safe(papers, answers, [("u", "user_id"), ("kd", "kind"), ("ed", "edition")]).select("paper_id", "answers")


@query("SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey <> b.l_partkey")
def j19_competing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with two different partners, as a minimum unlike the maximum instead of a self-join."""
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    return ends.where("a != b").select("l_orderkey").distinct()


@query("SELECT conv_id, turn, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS pairing FROM (SELECT q.conv_id, q.turn, (SELECT count(*) FROM conversations a WHERE a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn // 2 = q.turn // 2) AS n FROM conversations q WHERE role = 'user')")
def j21_label_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.floor(F.col("turn") / 2).alias("label")
    turns = table(spark, sf_dir, "conversations")
    found = J.matched_labels(turns.where("role = 'user'").select("conv_id", "turn", label), turns.where("role = 'assistant'").select("conv_id", label), ["conv_id", "label"])
    return found.select("conv_id", "turn", "pairing")


@query("WITH a AS (SELECT p_name AS k, min(p_partkey) AS old_id FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_size < 5 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p_name AS k, min(p_partkey) AS new_id FROM part WHERE p_type IN ('PROMO', 'MEDIUM') AND p_size < 5 GROUP BY 1 HAVING count(*) = 1) SELECT old_id, new_id FROM a JOIN b USING (k)")
def j23_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_name").alias("k"), "p_partkey", "p_type")
    return J.one_to_one(part.where("p_type in ('SMALL', 'LARGE')").withColumnRenamed("p_partkey", "old_id"), part.where("p_type in ('PROMO', 'MEDIUM')").withColumnRenamed("p_partkey", "new_id"), "k", "old_id", "new_id")


@query("SELECT l_orderkey, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS no_order, count(*) FILTER (WHERE p.p_partkey IS NULL) AS no_part, count(*) FILTER (WHERE s.s_suppkey IS NULL OR s.s_nationkey <> c.c_nationkey) AS other_nation FROM lineitem LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN customer c ON o_custkey = c_custkey GROUP BY 1")
def j24_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    other = F.col("s_suppkey").isNull() | (F.col("s_nationkey") != F.col("c_nationkey"))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("o_orderkey").isNull()).alias("no_order"), F.count_if(F.col("p_partkey").isNull()).alias("no_part"), F.count_if(other).alias("other_nation"))


@query("WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1) SELECT s_suppkey, count(*) AS questions FROM s JOIN supplier ON list_contains(ids, s_suppkey) GROUP BY 1")
def j25_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment as explode and an equi-join, not a loop over pairs."""
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return ids.select(F.explode("ids").alias("s_suppkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("questions"))


@query("SELECT l_orderkey, p_brand AS node, round_even(sum(l_discount), 6) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def j26_anchor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("node"))
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "node").agg(F.bround(F.sum("l_discount"), 6).alias("weight"))


RANGES = "SELECT s_suppkey AS range_id, s_nationkey * 20 AS start_k, s_nationkey * 20 + s_suppkey % 30 AS end_k FROM supplier"


@query(f"WITH r AS ({RANGES}) SELECT p_partkey, range_id FROM part JOIN r ON p_partkey BETWEEN start_k AND end_k")
def n21_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("range_id"), (F.col("s_nationkey") * 20).alias("start_k"), (F.col("s_nationkey") * 20 + F.col("s_suppkey") % 30).alias("end_k"))
    return J.range_join(table(spark, sf_dir, "part").select("p_partkey"), ranges, "p_partkey", "start_k", "end_k", 32).select("p_partkey", "range_id")


@query(f"WITH r AS ({RANGES}) SELECT DISTINCT a.range_id FROM r a JOIN r b ON a.start_k = b.start_k AND (b.end_k, b.range_id) < (a.end_k, a.range_id)")
def n21_overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("range_id"), (F.col("s_nationkey") * 20).alias("start_k"), (F.col("s_nationkey") * 20 + F.col("s_suppkey") % 30).alias("end_k"))
    return J.overlaps(ranges, "start_k", "range_id", "start_k", "end_k").select("range_id")


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS binding FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def n39_unique_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_or_null(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("binding")), ["o_custkey"], "binding")


@query("WITH t AS (SELECT DISTINCT p_type, p_brand, p_size FROM part WHERE p_size < 4), k AS (SELECT p_partkey, p_type, p_brand, p_size FROM part) SELECT p_partkey, coalesce((SELECT 1 FROM t WHERE t.p_type = k.p_type AND t.p_brand = k.p_brand AND t.p_size = k.p_size), (SELECT DISTINCT 2 FROM t WHERE t.p_type = k.p_type AND t.p_brand = k.p_brand), 3) AS priority FROM k")
def n15_profile_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, brand, size), else (type, brand), else type."""
    part = table(spark, sf_dir, "part")
    known = part.where("p_size < 4").select("p_type", "p_brand", "p_size").distinct()
    rows = part.select("p_partkey", "p_type", "p_brand", "p_size").join(known.withColumn("a", F.lit(1)), ["p_type", "p_brand", "p_size"], "left").join(known.select("p_type", "p_brand").distinct().withColumn("b", F.lit(2)), ["p_type", "p_brand"], "left")
    return rows.select("p_partkey", F.coalesce("a", "b", F.lit(3)).alias("priority"))
