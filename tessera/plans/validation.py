"""Queries over validation, imports and source evidence, on stand-ins from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import validation as V
from tessera.operators.compare import exact_cover
from tessera.operators.gates import codes
from tessera.plans.registry import query
from tessera.sources.tables import partitions, table

BOUNDS = V.Bounds(shortest=4, longest=45, options=3)

UNITS_SQL = """u AS (SELECT l_orderkey AS document, l_returnflag AS scope, l_orderkey * 10 + l_linenumber AS unit, l_linenumber AS number, l_discount < 0.09 AS gradable,
  CASE WHEN l_quantity < 48 THEN l_quantity END AS marks, floor(l_quantity) - 1 AS chars, l_linestatus = 'O' AS mcq, l_linenumber AS options, l_tax > 0.01 AS has_key,
  CASE WHEN l_discount < 0.01 THEN 'ambiguous' WHEN l_discount < 0.08 THEN 'found' END AS answer, l_linenumber AS first_page, floor(l_tax * 100) + 2 AS last_page FROM lineitem)"""
FOUND_SQL = f"""{UNITS_SQL},
n AS (SELECT document, scope, number, min(unit) AS unit, row_number() OVER (PARTITION BY document, scope ORDER BY number) AS expected FROM u GROUP BY 1, 2, 3),
f AS (SELECT document, unit, unnest([CASE WHEN gradable AND marks IS NULL THEN 'V2_MISSING_MARKS' END, CASE WHEN gradable AND chars = 0 THEN 'V5_UNIT_EMPTY' END,
    CASE WHEN gradable AND chars > 0 AND chars < 4 THEN 'V5_UNIT_TOO_SHORT' END, CASE WHEN chars > 45 THEN 'V5_UNIT_TOO_LONG' END, CASE WHEN mcq AND options < 3 THEN 'V6_MCQ_OPTIONS_MISSING' END,
    CASE WHEN first_page > last_page THEN 'V7_PAGE_SPAN_INVALID' END, CASE WHEN gradable AND answer = 'ambiguous' THEN 'V4_AMBIGUOUS_ANSWER' END,
    CASE WHEN gradable AND (answer IS NULL OR answer <> 'found') THEN 'V4_MISSING_ANSWER' END, CASE WHEN mcq AND NOT has_key THEN 'V6_MCQ_KEY_MISSING' END]) AS code FROM u
  UNION ALL SELECT document, unit, 'V1_QUESTION_GAP' FROM n WHERE number <> expected
  UNION ALL SELECT document, NULL, 'V4_MISSING_ANSWERS_ERROR' FROM u GROUP BY 1 HAVING count(*) FILTER (WHERE gradable AND (answer IS NULL OR answer <> 'found')) > count(*) FILTER (WHERE gradable) * 0.1::DOUBLE)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the numbered units of a document, whose units lie together."""
    discount = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").repartition(partitions(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("document"), F.col("l_returnflag").alias("scope"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.col("l_linenumber").alias("number"), (discount < 0.09).alias("gradable"),
        F.when(F.col("l_quantity") < 48, F.col("l_quantity")).alias("marks"), (F.floor("l_quantity") - 1).alias("chars"), (F.col("l_linestatus") == "O").alias("mcq"), F.col("l_linenumber").alias("options"), (F.col("l_tax") > 0.01).alias("has_key"),
        F.when(discount < 0.01, "ambiguous").when(discount < 0.08, "found").alias("answer"), F.col("l_linenumber").alias("first_page"), (F.floor(F.col("l_tax") * 100) + 2).alias("last_page"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document and code of every broken rule, a document's together in one of as many partitions as the table is large."""
    return V.unit_issues(units(spark, sf_dir), BOUNDS).select("document", "code").repartition(partitions(spark, sf_dir, "lineitem"), "document")


@query(f"WITH {FOUND_SQL} SELECT document, code, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY 1, 2")
def q17_validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite of rules V1, V2, V4 to V7 over every unit, counted by document and code."""
    return issues(spark, sf_dir).groupBy("document", "code").agg(F.count("*").alias("n"))


@query(f"WITH {FOUND_SQL}, e AS (SELECT document, bool_or(code IN {V.ERRORS}) AS bad FROM f WHERE code IS NOT NULL GROUP BY 1) SELECT o_orderkey AS document, CASE WHEN bad THEN 'needs_review' WHEN bad IS NOT NULL THEN 'ok_with_warnings' ELSE 'ok' END AS outcome FROM orders LEFT JOIN e ON document = o_orderkey")
def q17_validation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's outcome from its codes; documents without units are ok."""
    found = issues(spark, sf_dir).groupBy("document").agg(F.collect_set("code").alias("codes"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"))
    return orders.join(found, "document", "left").select("document", V.outcome(F.col("codes")).alias("outcome"))


@query("""WITH t AS (SELECT l_orderkey, sum(l_quantity) AS raw, sum(l_quantity) FILTER (WHERE l_linenumber <= 3) AS best FROM lineitem GROUP BY 1), s AS (SELECT *, 100 AS top, CASE WHEN l_orderkey % 2 = 0 THEN 3 END AS pick FROM t)
SELECT l_orderkey, CASE WHEN d = 0 THEN NULL WHEN d <= 2 THEN 'V3_TOTAL_MARKS_WARN' WHEN pick IS NULL AND raw BETWEEN 100 AND 160 THEN 'V3_TOTAL_MARKS_RAW_WARN' ELSE 'V3_TOTAL_MARKS_MISMATCH' END AS code
FROM (SELECT *, abs(CASE WHEN pick IS NULL THEN raw ELSE coalesce(best, 0) END - top) AS d FROM s)""")
def q17_total_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule V3: even documents have a choice rule of three units, odd ones none."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("raw"), F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity"))).alias("best"))
    pick = F.when(F.col("l_orderkey") % 2 == 0, 3)
    attemptable = F.when(pick.isNull(), F.col("raw")).otherwise(F.coalesce("best", F.lit(0.0)))
    return t.select("l_orderkey", V.total_issue(attemptable, F.col("raw"), F.lit(100), pick).alias("code"))


MAPPING_SQL = """m AS (SELECT l_orderkey, list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS expected, list({'part': l_linenumber, 'label': p_brand, 'paper': p_type, 'evidence': CASE WHEN l_tax > 0 THEN 'seen' ELSE '' END}) FILTER (WHERE l_linestatus = 'O') AS given,
  list(DISTINCT p_brand) FILTER (WHERE l_discount < 0.08) AS candidates, min(p_type) AS home FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
g AS (SELECT l_orderkey, coalesce(expected, []) AS expected, coalesce(list_transform(given, lambda x: x.part), []) AS parts, coalesce(given, []) AS given, coalesce(candidates, []) AS candidates, home FROM m)"""


@query(f"""WITH {MAPPING_SQL} SELECT l_orderkey, concat_ws(',', CASE WHEN NOT list_has_all(parts, expected) THEN 'part_missing' END, CASE WHEN NOT list_has_all(expected, parts) THEN 'part_unknown' END, CASE WHEN len(parts) > len(list_distinct(parts)) THEN 'part_repeated' END,
  CASE WHEN len(list_filter(given, lambda x: NOT list_contains(candidates, x.label))) > 0 THEN 'label_not_candidate' END, CASE WHEN home <> 'ECONOMY' AND len(list_filter(given, lambda x: x.paper <> home)) > 0 THEN 'label_of_other_paper' END,
  CASE WHEN len(list_filter(given, lambda x: x.evidence = '')) > 0 THEN 'evidence_missing' END) AS errors FROM g""")
def t27_mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured output against its unit (T27, N32): orders are units, open lines the mapped parts, brands labels, types papers."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    given = F.struct(F.col("l_linenumber").alias("part"), F.col("p_brand").alias("label"), F.col("p_type").alias("paper"), F.when(F.col("l_tax") > 0, "seen").otherwise("").alias("evidence"))
    units_ = rows.groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("expected"), F.collect_list(F.when(F.col("l_linestatus") == "O", given)).alias("given"),
        F.collect_set(F.when(F.col("l_discount") < 0.08, F.col("p_brand"))).alias("candidates"), F.min("p_type").alias("home"),
    )
    errors = V.mapping_errors(F.col("expected"), F.col("given"), F.col("candidates"), F.col("home"), "ECONOMY")
    return units_.select("l_orderkey", F.array_join(errors, ",").alias("errors"))


@query("""WITH i AS (SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN -o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_totalprice > 300000 THEN 'changed' ELSE o_orderpriority END AS digest, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS n FROM orders)
SELECT id, CASE WHEN n > 1 THEN 'duplicate' WHEN k.o_orderkey IS NULL THEN 'unknown' WHEN k.o_orderstatus <> 'F' THEN 'inserted' WHEN k.o_orderpriority = digest THEN 'skipped' ELSE 'conflict' END AS action FROM i LEFT JOIN orders k ON k.o_orderkey = id""")
def n57_import_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import does with each result: known ids are orders, fulfilled ones are stored, partial ones come twice."""
    orders = table(spark, sf_dir, "orders")
    one = orders.select(F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("id"), F.when(F.col("o_totalprice") > 300000, "changed").otherwise(F.col("o_orderpriority")).alias("digest"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("n"))
    incoming = one.select("id", "digest", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    stored = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("digest"))
    return V.import_actions(incoming, orders.select(F.col("o_orderkey").alias("id")), stored, "id", "digest")


@query("SELECT o_custkey, count(*) = count(DISTINCT o_orderdate) AS \"unique\", bool_and(o_orderstatus <> 'P') AS intact FROM orders GROUP BY 1")
def n27_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a batch named by dates: distinct, and intact where no partial order was left out of its digest."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    stated = orders.where("o_orderstatus != 'P'").groupBy("o_custkey").agg(V.digest_sum("o_orderdate", "o_totalprice").alias("digest"))
    return V.manifest_errors(orders, "o_custkey", "o_orderdate", "o_totalprice", stated)


@query("SELECT l_partkey AS id, CASE WHEN p THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT coalesce(a.k, b.k) AS l_partkey, a.k IS NOT NULL AS p, a.k IS NULL OR b.k IS NULL AS off FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 2) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size < 48) b ON a.k = b.k) WHERE off")
def s14_pack_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the packs of a corpus hold exactly the expected ids: those on one side only (S13's count check alike)."""
    packed = table(spark, sf_dir, "lineitem").where("l_quantity > 2").select(F.col("l_partkey").alias("id"))
    return exact_cover(packed, table(spark, sf_dir, "part").where("p_size < 48").select(F.col("p_partkey").alias("id")), "id")


@query("""WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS kind, strftime(o_orderdate, '%Y') AS attempt, CAST(floor(o_totalprice / 10000) AS BIGINT) AS page FROM orders)
SELECT id, attempt, CASE kind WHEN '1-URGENT' THEN 'main' ELSE 'revision' END AS family FROM d WHERE kind IN ('1-URGENT', '2-HIGH') AND attempt BETWEEN '1993' AND '1996' AND (page BETWEEN 2 AND 8 OR page BETWEEN 15 AND 20 AND kind = '2-HIGH')""")
def n45_scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an attempt's scope by family and page ranges."""
    page = F.floor(F.col("o_totalprice") / 10000)
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.date_format("o_orderdate", "yyyy").alias("attempt"), page.alias("page"))
    ranges = lambda *pairs: F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in pairs))
    years = spark.range(1993, 1997).select(F.col("id").cast("string").alias("attempt"))
    scopes = years.select("attempt", F.lit("main").alias("family"), ranges((2, 8)).alias("ranges")).unionByName(years.select("attempt", F.lit("revision").alias("family"), ranges((2, 8), (15, 20)).alias("ranges")))
    return V.scoped(documents, scopes, {"1-URGENT": "main", "2-HIGH": "revision"})


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n, code FROM (SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'source_missing' WHEN o_orderstatus = 'P' THEN 'source_stale' WHEN l_linestatus <> o_orderstatus THEN 'source_changed' WHEN l_linenumber > 5 THEN 'pages_outside' END AS code
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 5000) WHERE code IS NOT NULL GROUP BY 1, 3""")
def n46_source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence against its source: lines cite orders, whose status is their digest and which have five pages."""
    evidence = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("span"), F.col("l_linestatus").alias("digest"), F.col("l_linenumber").alias("first"), F.col("l_linenumber").alias("last"))
    state = F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("current")
    spans = table(spark, sf_dir, "orders").where("o_totalprice > 5000").select(F.col("o_orderkey").alias("span"), state.alias("state"), F.col("o_orderstatus").alias("span_digest"), F.lit(1).alias("span_first"), F.lit(5).alias("span_last"))
    return V.evidence_errors(evidence, spans).groupBy("id", "code").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_partkey, 'Question No. ' || p_size || ' is compulsory. Attempt any ' || CASE WHEN p_size % 3 = 0 THEN 'four' WHEN p_size % 3 = 1 THEN '5' ELSE 'several' END || ' questions out of the rest.' AS line, p_size FROM part)
SELECT p_partkey, p_size AS compulsory, CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 END AS pick FROM t""")
def n17_choice_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction line's compulsory question and how many of the rest to pick, in figures or words."""
    kind = F.col("p_size") % 3
    line = F.concat(F.lit("Question No. "), F.col("p_size").cast("string"), F.lit(" is compulsory. Attempt any "), F.when(kind == 0, "four").when(kind == 1, "5").otherwise("several"), F.lit(" questions out of the rest."))
    compulsory, pick = V.choice_rule(line)
    return table(spark, sf_dir, "part").select("p_partkey", compulsory[0].alias("compulsory"), pick.alias("pick"))


@query("""WITH r AS (SELECT lower(p_type) AS a, lower(p_name) AS b, p_partkey AS k FROM part WHERE p_size < 10), h AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE lower(p_brand) END AS a, lower(p_name) AS b FROM part),
e AS (SELECT a, b, count(*) AS n, min(k) AS k FROM r GROUP BY 1, 2), t AS (SELECT b, count(*) AS n, min(k) AS k FROM r GROUP BY 1)
SELECT id, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 OR t.n > 1 THEN 'ambiguous' WHEN t.n = 1 THEN 'title_only' ELSE 'missing' END AS state, CASE WHEN e.n = 1 THEN e.k WHEN e.n IS NULL AND t.n = 1 THEN t.k END AS target FROM h LEFT JOIN e USING (a, b) LEFT JOIN t USING (b)""")
def t26_heading_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of parts against a reference of the small ones, by path and then by title."""
    part = table(spark, sf_dir, "part")
    reference = part.where("p_size < 10").select(F.array("p_type", F.concat(F.lit(" "), "p_name")).alias("path"), F.col("p_partkey").alias("target"))
    headings = part.select(F.col("p_partkey").alias("id"), F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")), F.upper("p_name")).alias("path"))
    return V.reconciled(headings, reference)


@query("""WITH q AS (SELECT o_custkey, strftime(o_orderdate, '%Y') AS y, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey, strftime(o_orderdate, '%Y') AS y, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT o_orderkey, concat_ws(',', CASE WHEN n IS NULL THEN 'no_answers' END, CASE WHEN n > 1 THEN 'competing_answers' END, CASE WHEN p <> o_orderpriority THEN 'papers_differ' END) AS gates FROM q LEFT JOIN a USING (o_custkey, y)""")
def n25_pair_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a question paper from being paired: no answers of its identity, several, or of another paper."""
    keyed = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy").alias("y"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    answers = keyed.where("o_orderstatus = 'O'").groupBy("o_custkey", "y").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("p"))
    rows = keyed.where("o_orderstatus = 'F'").join(answers, ["o_custkey", "y"], "left")
    gates = codes([("no_answers", F.col("n").isNull()), ("competing_answers", F.col("n") > 1), ("papers_differ", F.col("p") != F.col("o_orderpriority"))])
    return rows.select("o_orderkey", F.array_join(gates, ",").alias("gates"))
