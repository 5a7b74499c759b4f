"""Queries of catalogues, pins and listings, and of the parts that longer queries are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.extraction import draft_candidates
from tessera.functions import text as T
from tessera.operators import compare as C
from tessera.operators import scoring as S
from tessera.operators import tree
from tessera.operators import windows as W
from tessera.plans import model
from tessera.plans.registry import query
from tessera.sources.sinks import appended_once
from tessera.sources.tables import pending, table

# --- catalogues and pins


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def s03_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of some statuses that nothing supersedes, newest first."""
    superseded = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return pending(rows.join(superseded, "id", "left_anti"), ["O", "P"])


@query("SELECT o_orderpriority, o_orderkey, outcome FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'skipped_small' WHEN o_orderstatus = 'F' THEN 'present' WHEN o_orderstatus = 'P' THEN 'retry' ELSE 'fetch' END AS outcome FROM orders) WHERE outcome IN ('fetch', 'retry') ORDER BY outcome, o_orderdate DESC, o_orderkey LIMIT 500")
def s07_inventory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory entries by their outcome, the first that apply; a plan ends at its limit (the feature)."""
    outcome = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000), "skipped_small").when(F.col("o_orderstatus") == "F", "present").when(F.col("o_orderstatus") == "P", "retry").otherwise("fetch")
    rows = table(spark, sf_dir, "orders").withColumn("outcome", outcome).where(F.col("outcome").isin("fetch", "retry"))
    return rows.orderBy("outcome", F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderpriority", "o_orderkey", "outcome")


@query("SELECT table_name, column_name FROM (VALUES ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('orders', 'o_orderpriority'), ('part', 'p_partkey'), ('part', 'p_name'), ('part', 'p_brand'), ('part', 'p_type'), ('part', 'p_size'), ('part', 'p_retailprice')) t(table_name, column_name)")
def s15_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns from the readers' schemas; no row is read."""
    rows = [(name, c) for name in ("orders", "part") for c in table(spark, sf_dir, name).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


@query("SELECT * FROM (VALUES ('p_kind', 'unexpected'), ('p_name', 'missing'), ('p_size', 'changed')) t(name, difference)")
def u06_schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, unexpected and changed columns between a table and its baseline."""
    old = table(spark, sf_dir, "part")
    new = old.drop("p_name").withColumn("p_size", F.col("p_size").cast("string")).withColumn("p_kind", F.lit(1))
    return spark.createDataFrame(C.schema_diff(old, new), "name string, difference string")


@query("SELECT o_orderpriority AS part, count(*) FILTER (WHERE o_orderstatus <> 'P') = count(*) AS equal FROM orders GROUP BY 1")
def u05_multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a restored copy holds the same rows, as often: digests by part instead of two full anti-joins."""
    rows = table(spark, sf_dir, "orders")
    digest = lambda d, name: C.multiset_digest(d, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("part"), F.concat_ws(":", "n", "digest").alias(name))
    return digest(rows, "a").join(digest(rows.where("o_orderstatus != 'P'"), "b"), "part", "left").select("part", F.col("a").eqNullSafe(F.col("b")).alias("equal"))


@query("SELECT p_type AS release, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS place FROM part WHERE p_brand <> 'Brand#13'")
def n03_release_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a release in the order of (sequence, id); N2 is the same scan by a semi-join with the version's ids."""
    version = table(spark, sf_dir, "part").where("p_brand != 'Brand#13'").select("p_partkey")
    rows = table(spark, sf_dir, "part").join(version, "p_partkey", "left_semi")
    return rows.select(F.col("p_type").alias("release"), F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_type").orderBy("p_size", "p_partkey")).alias("place"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n, coalesce(s_name, 'index') AS source, CASE WHEN s_suppkey IS NULL THEN 0 ELSE l_linenumber END AS page FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1, 3, 4")
def n05_source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's artifact and page, with defaults where the artifact has no metadata."""
    artifacts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = table(spark, sf_dir, "lineitem").join(artifacts, "l_suppkey", "left")
    return rows.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.coalesce("s_name", F.lit("index")).alias("source"), F.when(F.col("s_name").isNull(), 0).otherwise(F.col("l_linenumber")).alias("page")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS paper, count(DISTINCT p_brand) AS chapters, count(DISTINCT p_brand || p_name) AS topics, count(*) AS subtopics FROM part GROUP BY 1")
def n09_load_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("paper")).agg(F.count_distinct("p_brand").alias("chapters"), F.count_distinct(F.concat("p_brand", "p_name")).alias("topics"), F.count("*").alias("subtopics"))


DRAFTS_URL = "https://example.org/module.pdf"


@query(f"""WITH p AS (SELECT p_type AS t, p_brand AS b, p_partkey, p_name, p_size > 25 AS has FROM part),
leaf AS (SELECT 'part:' || p_partkey AS id, [t, b, p_name] AS titles, ['chapter::' || t, 'topic:' || right(b, 2) || ':' || b, 'subtopic:' || p_partkey || ':' || p_name] AS labels FROM p WHERE has
  UNION ALL SELECT 'topic:' || t || '|' || b, [t, b], ['chapter::' || t, 'topic:' || right(b, 2) || ':' || b] FROM p GROUP BY t, b HAVING NOT bool_or(has)),
h AS (SELECT id, titles, list_transform(range(1, len(labels) + 1), lambda i: sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{DRAFTS_URL}#' || array_to_string(labels[1:i], '/')))) AS hs FROM leaf),
u AS (SELECT id, titles, list_transform(hs, lambda x: concat_ws('-', x[1:8], x[9:12], '5' || x[14:16], translate(x[17], '0123456789abcdef', '89ab89ab89ab89ab') || x[18:20], x[21:32])) AS us FROM h)
SELECT id, us[len(us)] AS node_id, array_to_string(us, ',') AS path, array_to_string(titles, ' / ') AS scope FROM u""")
def n12_draft_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Childless topics and subtopics of an index of types, brands and larger parts, with ids drawn from their paths."""
    part = table(spark, sf_dir, "part")
    topic = F.concat(F.lit("topic:"), "p_type", F.lit("|"), "p_brand")
    chapter = F.concat(F.lit("chapter:"), "p_type")
    none = F.lit(None).cast("string")
    chapters = part.select(chapter.alias("id"), none.alias("parent_id"), F.lit("chapter").alias("kind"), none.alias("number"), F.col("p_type").alias("title")).distinct()
    topics = part.select(topic.alias("id"), chapter.alias("parent_id"), F.lit("topic").alias("kind"), F.substring("p_brand", -2, 2).alias("number"), F.col("p_brand").alias("title")).distinct()
    parts = part.where("p_size > 25").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), topic.alias("parent_id"), F.lit("subtopic").alias("kind"), F.col("p_partkey").cast("string").alias("number"), F.col("p_name").alias("title"))
    found = draft_candidates(chapters.unionByName(topics).unionByName(parts), DRAFTS_URL)
    return found.select("id", "node_id", F.array_join(F.transform("path", lambda x: x["id"]), ",").alias("path"), "scope")


@query("""WITH d AS (SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS k FROM lineitem GROUP BY 1), r AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey AS id, p_type || '/' || p_brand AS path, k AS descriptor, coalesce(n, 0) AS refs, sha256(p_type || '/' || p_brand || '|' || coalesce(k, -1) || '|' || coalesce(n, 0)) AS digest FROM part LEFT JOIN d ON d.l_partkey = p_partkey LEFT JOIN r ON r.l_partkey = p_partkey WHERE p_size <> 1""")
def n26_candidate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible leaves with path, latest descriptor, distinct references, and a digest over them."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("k"), F.count_distinct("l_suppkey").alias("n"))
    rows = table(spark, sf_dir, "part").where("p_size != 1").join(found, "p_partkey", "left")
    path, n = F.concat_ws("/", "p_type", "p_brand"), F.coalesce("n", F.lit(0))
    digest = F.sha2(F.concat_ws("|", path, F.coalesce("k", F.lit(-1)).cast("string"), n.cast("string")), 256)
    return rows.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("k").alias("descriptor"), n.alias("refs"), digest.alias("digest"))


@query("SELECT o_custkey AS id, sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 8))::BIGINT)::VARCHAR AS pin FROM orders GROUP BY 1")
def n37_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pin of each owner's rows over listed columns: a sum of hashes, whatever their order."""
    row = F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias("pin"))


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('5-LOW') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def n38_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows without a projection, neither blind nor experimental: what a backfill appends, once."""
    orders = table(spark, sf_dir, "orders")
    due = orders.where("o_orderstatus = 'F' and o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    projected = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return appended_once(projected, due, ["id"], "value")


@query("SELECT o_custkey AS scope, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS run FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1")
def n41_current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current run of each scope: finished, not a shadow, greatest (generation, id)."""
    ok = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority != '5-LOW'")
    return ok.groupBy(F.col("o_custkey").alias("scope")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("run"))


@query("SELECT user_id, coalesce(list(DISTINCT k ORDER BY k) FILTER (WHERE event_type = 'purchase'), [0, 1, 2])::VARCHAR AS papers FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def n42_selected_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own list of papers, or all current ones."""
    k = F.get_json_object("props", "$.k").cast("long")
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("event_type") == "purchase", k))).alias("own"))
    papers = F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(*(F.lit(i).cast("long") for i in range(3))))
    return own.select("user_id", F.concat(F.lit("["), F.array_join(F.transform(papers, lambda p: p.cast("string")), ", "), F.lit("]")).alias("papers"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 100000 THEN 'strong' WHEN o_totalprice < 250000 THEN 'fair' ELSE 'weak' END AS band, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders WHERE o_orderpriority = '1-URGENT'")
def n48_gate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a paper by band, newest first."""
    price = F.col("o_totalprice")
    band = F.when(price < 100000, "strong").when(price < 250000, "fair").otherwise("weak")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", band.alias("band"), place.alias("newest"))


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS verified, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS provisional, count(*) FILTER (WHERE l_returnflag = 'R') AS withheld FROM lineitem GROUP BY 1")
def n51_values_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values shown by the reviewed quality: verified, provisional, or withheld."""
    kind = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "provisional").otherwise("withheld")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", kind.alias("kind"))
    shown = lambda k: F.sum(F.when(F.col("kind") == k, F.col("l_quantity"))).alias(k)
    return rows.groupBy("l_orderkey").agg(shown("verified"), shown("provisional"), F.count_if(F.col("kind") == "withheld").alias("withheld"))


@query("SELECT event_type || '-' || user_id AS name, strftime(max(ts), '%Y-%m-%d %H:%M') AS newest, CAST(floor((epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(max(ts))) / 3600) AS BIGINT) AS age_hours FROM events GROUP BY 1")
def n54_backup_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a backup, with its newest time and age in whole hours."""
    name = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.max("ts").alias("at"))
    age = F.floor(F.timestamp_diff("MICROSECOND", F.col("at"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")) / 3_600_000_000)
    return rows.select("name", F.date_format("at", "yyyy-MM-dd HH:mm").alias("newest"), age.alias("age_hours"))


@query("SELECT conv_id, turn, left(text, 80) AS preview FROM conversations WHERE role = 'assistant' AND length(text) > 40 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 4)")
def n55_curation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested gradable units that still wait, with previews: filtered before any limit."""
    turns = table(spark, sf_dir, "conversations")
    done = turns.where("turn > 4").select("conv_id")
    return turns.where((F.col("role") == "assistant") & (F.length("text") > 40)).join(done, "conv_id", "left_anti").select("conv_id", "turn", F.substring("text", 1, 80).alias("preview"))


@query("SELECT o_orderpriority AS run, count(*) AS seen, count(*) FILTER (WHERE o_orderstatus = 'F') AS stored, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, '{\"seen\":' || count(*) || ',\"stored\":' || count(*) FILTER (WHERE o_orderstatus = 'F') || '}' AS stats FROM orders GROUP BY 1")
def a30_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, and the JSON that is stored with it."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count("*").alias("seen"), F.count_if(F.col("o_orderstatus") == "F").alias("stored"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))
    return rows.withColumn("stats", F.to_json(F.struct("seen", "stored")))


# --- nested values and texts


@query("SELECT conv_id, count(*) AS nodes, max(turn) AS depth, string_agg(role || ':' || length(text), '/' ORDER BY turn) AS walk FROM conversations GROUP BY 1")
def x09_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over nested parts in reading order, from arrays of structs."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    walk = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["role"], p["size"].cast("string"))), "/")
    return rows.select("conv_id", F.size("parts").cast("long").alias("nodes"), F.array_max(F.transform("parts", lambda p: p["turn"])).alias("depth"), walk.alias("walk"))


@query("SELECT l_orderkey, count(DISTINCT md5(l_returnflag || '|' || l_linestatus)) AS kinds FROM lineitem GROUP BY 1")
def x14_dedup_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs of an array that differ by their digest."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.md5(F.concat_ws("|", "l_returnflag", "l_linestatus"))).alias("digests"))
    return rows.select("l_orderkey", F.size(F.array_distinct("digests")).cast("long").alias("kinds"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def t14_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks collapsed and stripped, whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("digest"))


@query("SELECT lower(p_name) = lower('RED Widget') AS same, lower(p_brand) AS brand, count(*) AS n FROM part GROUP BY 1, 2")
def t13_case_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.lower("p_name") == F.lower(F.lit("RED Widget"))).alias("same"), F.lower("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'red%' AND p_brand LIKE '%1_' AND p_name NOT LIKE '%bolt'")
def f07_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").like("red%") & F.col("p_brand").like("%1_") & ~F.col("p_name").like("%bolt")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 150000 AND (o_orderstatus = 'F') IS NOT FALSE AND o_orderdate IS NOT NULL")
def f03_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, lists, ranges, nulls and a three-valued boolean; all but the last reach the scan."""
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(True))
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(50000, 150000) & done & F.col("o_orderdate").isNotNull()).select("o_orderkey")


@query(f"WITH RECURSIVE {model.NODES_SQL} SELECT id FROM nodes n WHERE level = 'subtopic' AND status = 'active' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.id)")
def f11_leaf_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active subtopics without children."""
    return tree.leaves(model.nodes(spark, sf_dir), "subtopic").where("status = 'active'").select("id")


# --- parts of the scoring model


@query("SELECT o_orderkey, 24020 - (year(o_orderdate) * 12 + month(o_orderdate)) AS age FROM orders")
def m01_month_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(model.TARGET) - S.month_index(F.year(at), F.month(at))).alias("age"))


@query("SELECT o_orderkey, round_even(pow(2.0::DOUBLE, -(24020 - (year(o_orderdate) * 12 + month(o_orderdate))) / 24.0::DOUBLE), 9) AS exam, 1.0::DOUBLE AS flat FROM orders")
def m02_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life decay, and none of a half-life that isn't positive."""
    at = F.col("o_orderdate")
    age = F.lit(model.TARGET) - S.month_index(F.year(at), F.month(at))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bround(S.decay(age, 24.0), 9).alias("exam"), S.decay(age, 0.0).alias("flat"))


@query(f"WITH {model.TAGS_SQL} SELECT appearance, round_even(sum(marks * share * CASE WHEN cross_paper THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN stale THEN 0.5::DOUBLE ELSE 1 END), 6) AS marks FROM tags GROUP BY 1")
def m03_attributed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by share, halved across papers and halved under stale law."""
    marks = S.attributed_marks(F.col("marks"), F.col("share"), F.col("cross_paper"), F.col("stale"), S.ScoringConfig())
    return model.tags(spark, sf_dir).groupBy("appearance").agg(F.bround(F.sum(marks), 6).alias("marks"))


@query("SELECT p_partkey, CASE WHEN p_brand <> 'Brand#13' THEN round_even(p_retailprice / max(CASE WHEN p_brand <> 'Brand#13' THEN p_retailprice END) OVER (PARTITION BY p_type), 8) END AS part FROM part")
def m06_nullable_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component over its paper's top (A4): null where unavailable, which isn't zero; tops from a grouped join, not a window."""
    rows = table(spark, sf_dir, "part").withColumn("available", F.col("p_brand") != "Brand#13")
    tops = rows.where("available").groupBy("p_type").agg(F.max("p_retailprice").alias("top"))
    return rows.join(tops, "p_type", "left").select("p_partkey", F.bround(S.component(F.col("p_retailprice"), F.coalesce("top", F.lit(0.0)), F.col("available")), 8).alias("part"))


@query("SELECT user_id, count(*) AS tries, round_even(sum(value) / (count(*) * 100.0::DOUBLE) * 100, 1) AS pct FROM events WHERE event_type = 'purchase' GROUP BY 1")
def m16_mock_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score over the most that could be had, in per cent to one place.

    Values add up in the events' order, so that a sum doesn't hang on how rows are dealt out: its last bit decides ties.
    DuckDB rounds the scaled double half-even; ``bround`` rounds its shortest decimal, which isn't a tie where the double is a bit beside one.
    """
    upto = Window.partitionBy("user_id").orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.count("*").over(upto).alias("tries"), F.sum("value").over(upto).alias("score"))
    rows = sums.groupBy("user_id").agg(F.max("tries").alias("tries"), F.max_by("score", "tries").alias("score"))
    return rows.select("user_id", "tries", (F.rint(F.col("score") / (F.col("tries") * 100.0) * 100 * 10) / 10).alias("pct"))


@query("SELECT p_partkey AS id, round_even(100 * p_retailprice / max(p_retailprice) OVER (PARTITION BY p_type), 2) AS pct_of_top, round_even(100 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_type), 4) AS pct_of_paper FROM part")
def n44_legacy_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values against their paper's top and total, recomputed from the rows."""
    part = table(spark, sf_dir, "part")
    tops = part.groupBy("p_type").agg(F.max("p_retailprice").alias("top"), F.sum("p_retailprice").alias("total"))
    share = lambda of: 100 * F.col("p_retailprice") / F.col(of)
    return part.join(tops, "p_type").select(F.col("p_partkey").alias("id"), F.bround(share("top"), 2).alias("pct_of_top"), F.bround(share("total"), 4).alias("pct_of_paper"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY 1")
def a07_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status (A13) and condition in one pass."""
    status = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(status("F", "done"), status("O", "open"), status("P", "partial"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m')) AS first_attempt, max(strftime(o_orderdate, '%Y-%m')) AS last_attempt, round_even(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS average FROM orders GROUP BY 1")
def a05_attempt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last attempt, and an average over applicable rows only (A9)."""
    attempt = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(attempt).alias("first_attempt"), F.max(attempt).alias("last_attempt"), F.bround(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("average"))


@query("SELECT event_type, CASE WHEN count(*) FILTER (WHERE value IS NOT NULL) >= 20 THEN round_even(count(*) FILTER (WHERE value > 50) / count(*) FILTER (WHERE value IS NOT NULL), 4) END AS rate FROM events GROUP BY 1")
def a31_guarded_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate, null below twenty samples."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    return rows.select("event_type", F.when(F.col("n") >= 20, F.bround(F.col("hits") / F.col("n"), 4)).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def w13_latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest review of each dimension wins, by a partial maximum."""
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_shipdate", "l_partkey", "l_linenumber"))
    return W.latest(rows.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "at"), ["l_orderkey", "l_returnflag"], "at").drop("at")
