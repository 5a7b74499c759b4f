"""Queries over publication gates, review queues and catalogues, on stand-ins from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gates as G
from tessera.operators import readiness as R
from tessera.operators.windows import latest
from tessera.plans.registry import query
from tessera.sources.tables import partitions, table

LINES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'needs_review' ELSE 'matched' END AS outcome, l_linestatus = 'O' AS excluded, CASE WHEN l_discount > 0.09 THEN 'proposed' ELSE 'reviewed' END AS allocation, CASE WHEN l_quantity < 49 THEN l_quantity END AS marks FROM lineitem"


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as publications, their lines as label mappings and marks allocations."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "needs_review").otherwise("matched").alias("outcome"), (F.col("l_linestatus") == "O").alias("excluded"))).alias("mappings"),
        F.collect_list(F.struct(F.when(F.col("l_discount") > 0.09, "proposed").otherwise("reviewed").alias("allocation_status"), F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("marks"))).alias("allocations"),
    )
    empty = "cast(array() as array<struct<{}>>)"
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    rows = rows.withColumn("mappings", F.coalesce("mappings", F.expr(empty.format("outcome:string,excluded:boolean")))).withColumn("allocations", F.coalesce("allocations", F.expr(empty.format("allocation_status:string,marks:double"))))
    return rows.withColumn("status", F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete")).withColumn("issues", F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("marks"))).otherwise(F.expr("cast(array() as array<string>)")))


@query(f"""WITH l AS ({LINES}), g AS (SELECT l_orderkey, bool_or(outcome <> 'matched' AND NOT excluded) AS open, bool_or(allocation <> 'reviewed' OR marks IS NULL) AS loose FROM l GROUP BY 1)
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'question_scope_incomplete' END, CASE WHEN open THEN 'labels_unresolved_without_explicit_exclusion' END,
  CASE WHEN g.l_orderkey IS NULL OR loose OR o_orderpriority = '5-LOW' THEN 'marks_allocation_unresolved' END) AS blockers FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def f15_publication_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publications(spark, sf_dir)
    return rows.select("o_orderkey", F.array_join(G.publication_exclusions(F.col("status"), F.col("mappings"), F.col("allocations"), F.col("issues")), ",").alias("blockers"))


@query("SELECT o_orderpriority AS paper, count(DISTINCT o_orderkey) AS roots, count(l_orderkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a22_mapping_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of nested arrays summed by paper."""
    return publications(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("paper")).agg(F.count("*").alias("roots"), F.sum(F.size("mappings").cast("long")).alias("parts"))


@query(f"SELECT o_orderkey, count(l_orderkey) AS n, count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN outcome || excluded END) AS kinds FROM orders LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey GROUP BY 1")
def x07_array_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of a nested array, and of its distinct structs (X14)."""
    return publications(spark, sf_dir).select("o_orderkey", F.size("mappings").cast("long").alias("n"), F.size(F.array_distinct("mappings")).cast("long").alias("kinds"))


ISSUES = ("V5_UNIT_EMPTY", "V4_MISSING_ANSWER", "V1_PART_GAP", "V2_MARKS_SUM", "other", "V6_MCQ_KEY_MISSING", "V7_PAGE_SPAN_INVALID")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extractions, each line an issue by its part's size."""
    name = F.element_at(F.array(*map(F.lit, ISSUES)), (F.col("p_size") % len(ISSUES) + 1).cast("int"))
    issues = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(name).alias("issues"))
    rows = table(spark, sf_dir, "orders").join(issues, "o_orderkey", "left").withColumn("issues", F.coalesce("issues", F.expr("cast(array() as array<string>)")))
    role = F.when(F.col("o_orderpriority") == "5-LOW", "answers").otherwise("questions")
    return rows.withColumn("quality", G.quality_dimensions(F.col("issues"), F.col("o_orderstatus") == "F", role, F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") > 200000))


ISSUES_SQL = f"""i AS (SELECT l_orderkey AS k, list(DISTINCT [{", ".join(f"'{c}'" for c in ISSUES)}][p_size % {len(ISSUES)} + 1]) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
e AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, coalesce(codes, []) AS codes FROM orders LEFT JOIN i ON k = o_orderkey),
q AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'pending' END AS metadata,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'not_applicable' WHEN list_contains(codes, 'V5_UNIT_EMPTY') THEN 'concern' ELSE 'pending' END AS questions,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_applicable' WHEN list_contains(codes, 'V4_MISSING_ANSWER') OR list_contains(codes, 'V6_MCQ_KEY_MISSING') THEN 'concern' ELSE 'pending' END AS answers,
  CASE WHEN list_contains(codes, 'V1_PART_GAP') OR list_contains(codes, 'V7_PAGE_SPAN_INVALID') THEN 'concern' ELSE 'pending' END AS ordering,
  CASE WHEN list_contains(codes, 'V2_MARKS_SUM') THEN 'concern' ELSE 'pending' END AS marks_choices, CASE WHEN o_totalprice > 200000 THEN 'concern' ELSE 'pending' END AS readability FROM e)"""


@query(f"WITH {ISSUES_SQL} SELECT o_orderkey, metadata, questions, answers, answers AS pairing, ordering, marks_choices, readability, 'pending' AS human_review FROM q")
def n20_quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractions(spark, sf_dir).select("o_orderkey", "quality.*")


@query(f"""WITH {ISSUES_SQL}, r AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT o_orderkey, metadata, CASE last WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'concern' ELSE questions END AS questions, CASE WHEN last = 'purchase' THEN 'passed' ELSE 'pending' END AS human_review
FROM q LEFT JOIN r ON user_id = o_custkey""")
def n24_reviewed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last review of a dimension replaces what extraction found."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    last = events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    rows = extractions(spark, sf_dir).join(last, "o_custkey", "left")
    passed = F.map_from_arrays(F.array(F.lit("questions"), F.lit("human_review")), F.array(F.lit("passed"), F.lit("passed")))
    reviews = F.when(F.col("last") == "purchase", passed).when(F.col("last") == "error", F.create_map(F.lit("questions"), F.lit("concern")))
    new = rows.withColumn("quality", G.overlaid(F.col("quality"), reviews))
    return new.select("o_orderkey", *(F.col(f"quality.{d}").alias(d) for d in ("metadata", "questions", "human_review")))


@query("""WITH base AS (SELECT o.*, c.*, n.n_regionkey AS version, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN c.c_nationkey + 1 ELSE c.c_nationkey END AS paper FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey AND o_orderstatus <> 'P' LEFT JOIN customer h ON h.c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = h.c_nationkey),
own AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, version, unnest([CASE WHEN o_orderpriority = '5-LOW' THEN 'experimental_suggestion' END, CASE WHEN version NOT IN (0, 1, 2) THEN 'taxonomy_review' END, CASE WHEN o_totalprice BETWEEN 110000 AND 120000 THEN 'stale_taxonomy' END, CASE WHEN c_custkey IS NULL THEN 'extraction_missing' END]
  || CASE WHEN c_custkey IS NULL THEN [] ELSE [CASE WHEN c_acctbal <= 0 OR c_mktsegment = 'BUILDING' THEN 'source_identity_or_provenance' END, CASE WHEN p.n_nationkey IS NULL OR paper <> c_nationkey OR p.n_regionkey = 3 THEN 'source_paper_scope' END, CASE WHEN o_totalprice > 250000 THEN 'stale_part_mapping' END,
  CASE WHEN o_totalprice < 20000 OR c_acctbal >= 8000 OR c_mktsegment = 'MACHINERY' THEN 'stale_extraction' END, CASE WHEN c_acctbal >= 8000 THEN 'extraction_not_current' END, CASE WHEN o_totalprice BETWEEN 100000 AND 110000 THEN 'stale_extraction_digest' END, CASE WHEN o_totalprice BETWEEN 120000 AND 130000 THEN 'stale_input_hash' END,
  CASE WHEN c_acctbal <= 0 THEN 'extraction_metadata' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'extraction_answers' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'extraction_human_review' END] END) AS code FROM base LEFT JOIN nation p ON p.n_nationkey = paper),
answers AS (SELECT o_orderkey, 'answer_source_identity_or_provenance' AS code FROM base b LEFT JOIN customer a ON a.c_custkey = b.o_custkey + 1 WHERE b.c_custkey IS NOT NULL AND coalesce(a.c_acctbal <= 0 OR a.c_mktsegment = 'BUILDING', true)),
nodes AS (SELECT o_orderkey, unnest([CASE WHEN bool_or(l_returnflag = 'R') THEN 'stale_descriptor:' || l_partkey END, CASE WHEN p_size <= 5 THEN 'descriptor_or_source_review:' || l_partkey END, CASE WHEN bool_or(l_quantity > 45) THEN 'stale_source_evidence:' || l_partkey END]) AS code FROM base JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, l_partkey, p_size),
a AS (SELECT o_orderkey, code FROM own UNION ALL SELECT * FROM answers UNION ALL SELECT * FROM nodes)
SELECT o_orderkey, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS blockers, coalesce(bool_or(code LIKE 'stale%' OR code = 'extraction_missing'), false) AS stale, count(code) = 0 AS eligible FROM a GROUP BY 1""")
def n33_readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blocker of each order as a suggestion, and whether its evidence is stale.

    Customers are documents with their extractions, nations papers, regions releases, parts nodes; an order's lines pin
    its candidates.  Ranges of prices pin something that isn't so any more.
    """
    orders, customer, nation, region, part, line = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "part", "lineitem"))
    price, balance, segment = F.col("o_totalprice"), F.col("c_acctbal"), F.col("c_mktsegment")
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_nationkey", F.col("n_regionkey").alias("version_id"))
    documents = customer.select(
        F.col("c_custkey").alias("document_id"), F.md5("c_name").alias("sha256"), F.when(balance > 0, "confirmed").otherwise("pending").alias("catalog_status"), F.lit("final").alias("course_level"), F.lit("s2023").alias("scheme_id"),
        F.when(segment != "BUILDING", "verified").otherwise("unverified").alias("provenance_status"), F.array("c_nationkey").alias("papers"), (segment == "MACHINERY").alias("superseded"), F.when(balance < 8000, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("current_extraction_id"),
    )
    states = {"metadata": F.when(balance > 0, "passed").otherwise("pending"), "answers": F.when(segment == "FURNITURE", "concern").otherwise("passed"), "human_review": F.when(segment == "HOUSEHOLD", "pending").otherwise("passed")}
    quality = F.struct(*(states.get(d, F.lit("not_applicable")).alias(d) for d in G.DIMENSIONS))
    extractions = customer.select(F.col("c_custkey").alias("extraction_id"), F.col("c_custkey").alias("document_id"), F.when(balance < 8000, "current").otherwise("draft").alias("status"), F.md5(F.upper("c_name")).alias("digest"), F.lit(None).cast("long").alias("base_extraction_id"), quality.alias("quality"))
    questions = orders.select(F.col("o_custkey").alias("extraction_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("context"), F.array("o_orderstatus").alias("parts"))
    papers = nation.select(F.col("n_nationkey").alias("paper_id"), F.lit("s2023").alias("scheme_id"), (F.col("n_regionkey") != 3).alias("is_current"))
    releases = region.select(F.col("r_regionkey").alias("version_id"), F.when(F.col("r_regionkey") == 3, "draft").otherwise("approved").alias("status"), F.when(F.col("r_regionkey") != 4, "reviewer").alias("approved_by"), F.md5("r_name").alias("manifest_hash"))
    nodes = part.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("version_id"), F.col("p_partkey").alias("node_id"), F.col("p_partkey").alias("descriptor_id"), F.md5("p_name").alias("descriptor_hash"), (F.col("p_size") > 5).alias("eligible"), F.md5("p_brand").alias("source_hash"))
    n = partitions(spark, sf_dir, "lineitem")
    old, moved = (F.when(pinned, bit).otherwise(0) for pinned, bit in ((F.col("l_returnflag") == "R", 1), (F.col("l_quantity") > 45, 2)))
    pins = line.where("l_orderkey is not null").select("l_orderkey", "l_partkey", (old + moved).alias("changed")).repartition(n, "l_partkey")
    pins = pins.groupBy("l_orderkey", "l_partkey").agg(F.bit_or("changed").alias("changed")).join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    owned = orders.join(home.hint("merge"), F.col("o_custkey") == F.col("c_custkey"), "left").join(region, F.col("version_id") == F.col("r_regionkey"), "left")
    order, pin = (F.struct(*names) for names in (("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_name", "c_nationkey", "version_id", "r_name"), ("l_partkey", "changed", "p_name", "p_brand")))
    # an order and its pins meet once, in one list, which every rule below reads
    met = owned.select("o_orderkey", order.alias("own")).unionByName(pins.select(F.col("l_orderkey").alias("o_orderkey"), pin.alias("pin")), allowMissingColumns=True).repartition(n, "o_orderkey")
    met = met.groupBy("o_orderkey").agg(F.collect_list(F.struct("own", "pin")).alias("met"))
    present = lambda name: F.transform(F.filter("met", lambda x: x[name].isNotNull()), lambda x: x[name])
    candidate = lambda x: F.struct(x["l_partkey"].alias("node_id"), x["l_partkey"].alias("descriptor_id"), F.when(x["changed"].bitwiseAND(1) > 0, "old").otherwise(F.md5(x["p_name"])).alias("descriptor_hash"), F.when(x["changed"].bitwiseAND(2) > 0, "old").otherwise(F.md5(x["p_brand"])).alias("source_hash"))
    rows = met.select(F.inline(present("own")), F.col("met")).withColumn("candidates", F.array_sort(F.transform(present("pin"), candidate)))
    extraction = F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.col("o_custkey"))
    context = F.when(price < 20000, "old").otherwise(F.col("o_orderpriority"))
    digest = F.md5(F.upper("c_name"))
    suggestions = rows.select(
        F.col("o_orderkey").alias("suggestion_id"), F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("document_id"), extraction.alias("extraction_id"), "version_id", (F.col("o_orderpriority") == "5-LOW").alias("experimental"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("paper_id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("source_documents"), context.alias("context"),
        F.when(price > 250000, F.array(F.lit("X"))).otherwise(F.array("o_orderstatus")).alias("parts"), F.when(price.between(100000, 110000), "old").otherwise(digest).alias("extraction_digest"), F.when(price.between(110000, 120000), "old").otherwise(F.md5("r_name")).alias("manifest_hash"), "candidates",
        F.when(price.between(120000, 130000), "old").otherwise(R.input_hash(F.col("o_orderkey"), F.col("o_custkey"), F.md5("c_name"), extraction, digest, context, F.col("candidates"))).alias("input_hash"),
    )
    found = R.suggestion_blockers(suggestions, documents, extractions, questions, papers, releases, nodes)
    return found.select(F.col("suggestion_id").alias("o_orderkey"), F.array_join("blockers", ",").alias("blockers"), "stale", "eligible")


TASKS_SQL = """g AS (SELECT c_nationkey AS paper, c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY ALL),
cov AS (SELECT paper, unnest([CASE WHEN low < -900 THEN 'sources_not_acquired' END, CASE WHEN n < 8 THEN 'pairing_unreviewed' END, CASE WHEN high > 9900 THEN 'labels_incomplete' END, CASE WHEN high < 9000 THEN 'inventory_short' END]) AS blocker FROM g),
docs AS (SELECT o.*, c_nationkey AS paper FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW'),
leaves AS (SELECT c_nationkey AS paper, c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'),
papers AS (SELECT n_nationkey AS paper FROM nation),
t AS (SELECT NULL AS paper, 3 AS stage, 'attempt_binding_unreviewed' AS blocker, 1 AS affected
UNION ALL SELECT n_nationkey, 2, 'source_manifest_gap', 1 FROM nation WHERE n_regionkey = 4
UNION ALL SELECT paper, CASE blocker WHEN 'sources_not_acquired' THEN 4 WHEN 'pairing_unreviewed' THEN 5 WHEN 'labels_incomplete' THEN 6 ELSE 7 END, blocker, 1 FROM cov WHERE blocker IS NOT NULL
UNION ALL SELECT s_nationkey, 1, 'textbook_source_unresolved', 1 FROM supplier WHERE s_acctbal <= 0 OR s_acctbal >= 9000 OR s_acctbal BETWEEN 4000 AND 5000
UNION ALL SELECT paper, 1, 'textbook_source_missing', 0 FROM papers WHERE paper NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT p.paper, 2, 'taxonomy_review_pending', count(c_custkey) FILTER (WHERE c_acctbal <= 1000) FROM papers p LEFT JOIN leaves USING (paper) GROUP BY 1 HAVING count(c_custkey) = 0 OR count(c_custkey) FILTER (WHERE c_acctbal <= 1000) > 0
UNION ALL SELECT paper, 4, 'question_source_missing', 0 FROM papers WHERE paper NOT IN (SELECT paper FROM docs)
UNION ALL SELECT paper, 4, 'source_metadata_unreviewed', 1 FROM docs WHERE o_orderstatus <> 'F' OR o_totalprice <= 50000
UNION ALL SELECT paper, 5, 'extraction_review_pending', CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END FROM docs WHERE o_orderstatus = 'P' OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT paper, 6, 'classification_unpublished', 0 FROM papers WHERE paper NOT IN (SELECT paper FROM docs WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
UNION ALL SELECT paper, 6, 'classification_disputed', 1 FROM docs WHERE o_orderstatus = 'O' AND o_totalprice > 400000
UNION ALL SELECT paper, 7, 'expected_inventory_unknown', 0 FROM papers WHERE paper NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT paper, 8, 'official_prior_unreviewed', count(*) FROM leaves WHERE c_acctbal > 9000 GROUP BY 1
UNION ALL SELECT NULL, 8, 'scores_unavailable_or_stale', 0)"""


def readiness_state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations as papers, customers as nodes, orders as documents, suppliers as textbooks, a region as the release and its run."""
    customer, nation, region, supplier, orders = (table(spark, sf_dir, n) for n in ("customer", "nation", "region", "supplier", "orders"))
    balance = F.col("c_acctbal")
    of_paper = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).where("o_orderpriority <> '5-LOW'").withColumn("paper_id", F.col("c_nationkey"))
    one = region.where("r_regionkey = 1")
    ledger = G.codes([("sources_not_acquired", F.min(balance) < -900), ("pairing_unreviewed", F.count("*") < 8), ("labels_incomplete", F.max(balance) > 9900), ("inventory_short", F.max(balance) < 9000)])
    return {
        "papers": nation.select(F.col("n_nationkey").alias("paper_id")),
        "bindings": one.select(F.lit("reviewed").alias("status"), F.lit(None).cast("string").alias("reviewed_by")),
        "releases": one.select(F.col("r_regionkey").alias("version_id"), F.lit("approved").alias("status")),
        "gaps": nation.where("n_regionkey = 4").select(F.col("n_nationkey").alias("paper_id"), F.lit(2).alias("stage")),
        "coverage": customer.groupBy(F.col("c_nationkey").alias("paper_id"), F.col("c_mktsegment").alias("source_family")).agg(ledger.alias("blockers")),
        "artifacts": supplier.select(F.col("s_nationkey").alias("paper_id"), F.when(F.col("s_acctbal") > 0, "verified").otherwise("missing").alias("availability"), F.when(F.col("s_acctbal") < 9000, "verified").otherwise("unknown").alias("applicability"), F.col("s_acctbal").between(4000, 5000).alias("fallback")),
        "members": customer.select(F.col("c_nationkey").alias("paper_id"), F.col("c_custkey").alias("node_id"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", "topic").otherwise("subtopic").alias("level"), (balance > 1000).alias("eligible")),
        "documents": orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("document_id"), F.array("c_nationkey").alias("papers"), F.col("c_mktsegment").alias("family"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("pending").alias("catalog_status"), F.when(F.col("o_totalprice") > 50000, "verified").otherwise("pending").alias("provenance_status"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("ready"), (F.col("o_orderpriority") == "5-LOW").alias("superseded"),
        ),
        "published": of_paper.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice > 300000").select("paper_id"),
        "disputes": of_paper.where("o_totalprice > 400000").select("paper_id", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status")),
        "priors": customer.select(F.col("c_custkey").alias("node_id"), F.when(balance <= 9000, "reviewer").alias("reviewed_by")),
        "runs": one.select(F.lit(True).alias("stale"), F.lit(1).alias("corpus_generation")),
    }


@query(f"WITH {TASKS_SQL} SELECT CAST(paper AS VARCHAR) AS paper_id, stage, blocker, count(*) AS tasks, CAST(sum(affected) AS BIGINT) AS affected FROM t GROUP BY ALL")
def a32_readiness_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each paper from being ready, over all stages."""
    return R.readiness_tasks(readiness_state(spark, sf_dir), 1)


@query(f"WITH {TASKS_SQL} SELECT CAST(p.paper AS VARCHAR) AS paper_id, (SELECT count(*) FROM t WHERE paper IS NULL) + (SELECT count(*) FROM t WHERE t.paper = p.paper) AS blocker_count FROM papers p")
def a32_blocker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each paper, those of every paper among them."""
    state = readiness_state(spark, sf_dir)
    return R.blocker_counts(state["papers"], R.readiness_tasks(state, 1))


KINDS = ("model_question", "rtp", "question_paper", "leaflet", "case_scenarios")


@query(f"""WITH r AS (SELECT o_orderkey, ['Final', 'Intermediate', 'Foundation', 'Basic'][o_custkey % 4 + 1] AS level, [{", ".join(f"'{k}'" for k in KINDS)}][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m') END AS attempt FROM orders)
SELECT o_orderkey, CASE WHEN level = 'Basic' THEN 'error_level' WHEN kind = 'leaflet' THEN 'error_type' WHEN attempt IS NULL AND kind IN ('rtp', 'question_paper') THEN 'error_attempt' WHEN level = 'Final' THEN 'final_queue' ELSE 'outside_corpus' END AS route FROM r""")
def n07_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))
    attempt = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.route(pick(("Final", "Intermediate", "Foundation", "Basic"), "o_custkey"), pick(KINDS, "o_orderkey"), attempt).alias("route"))


@query("""WITH s AS (SELECT p_type AS section_key, p_partkey, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 END AS r FROM part WHERE p_retailprice > 905),
best AS (SELECT section_key, min(r) AS r, count(*) FILTER (WHERE r = 0) AS n0, count(*) FILTER (WHERE r = 1) AS n1, min(p_partkey) FILTER (WHERE r = 0) AS s0, min(p_partkey) FILTER (WHERE r = 1) AS s1 FROM s WHERE r IS NOT NULL GROUP BY 1)
SELECT section_key, CASE WHEN n0 = 1 THEN s0 WHEN n0 = 0 AND n1 = 1 THEN s1 END AS section_id, coalesce(r = 1, false) AS is_fallback, CASE WHEN n0 > 1 OR n0 = 0 AND n1 > 1 THEN 'ambiguous edition' WHEN r IS NULL THEN 'no verified section' END AS reason FROM (SELECT DISTINCT p_type AS section_key FROM part) LEFT JOIN best USING (section_key)""")
def n06_edition_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified material of the target attempt, else of the fallback; several of the better kind are reported."""
    part = table(spark, sf_dir, "part")
    attempts = F.when(F.col("p_size") > 40, F.array(F.lit("2027-05"), F.lit("2026-01"))).when(F.col("p_size") > 20, F.array(F.lit("2026-01"))).otherwise(F.array(F.lit("2025-05")))
    sections = part.select(F.col("p_type").alias("section_key"), F.col("p_partkey").alias("section_id"), (F.col("p_retailprice") > 905).alias("verified"), attempts.alias("attempts"))
    return G.editions(part.select(F.col("p_type").alias("section_key")).distinct(), sections, "2027-05", strict=False)


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|cold) ') AND p_size > 25 THEN 'question' WHEN p_name LIKE '%bolt' AND p_retailprice >= 950 AND p_retailprice <= 1500 THEN 'part' WHEN p_size > 25 THEN 'heading' END AS rule FROM part")
def n16_positional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose pattern, weight and position a line meets."""
    rules = [("question", "^(red|cold) ", True, None, None), ("part", "bolt$", False, 950.0, 1500.0), ("heading", "", True, None, None)]
    return table(spark, sf_dir, "part").select("p_partkey", G.first_rule(F.col("p_name"), F.col("p_size") > 25, F.col("p_retailprice"), rules).alias("rule"))


@query("""WITH c AS (SELECT p_type AS paper, p_brand AS chapter, count(*) AS base, list(DISTINCT split_part(p_name, ' ', 1)) AS words FROM part GROUP BY ALL), t AS (SELECT p_type AS paper, min(p_name) || ' and ' || max(p_name) AS text FROM part GROUP BY 1),
s AS (SELECT paper, chapter, base + 15 * len(list_filter(words, lambda w: contains(text, w))) + 35 * (length(chapter) - 7) * 0.5::DOUBLE AS score FROM c JOIN t USING (paper)),
k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, chapter) AS place, max(score) OVER (PARTITION BY paper) AS best FROM s)
SELECT paper, chapter, round_even(score, 4) AS score, CAST(place AS INT) AS place FROM k WHERE place = 1 OR place = 2 AND score >= 0.85::DOUBLE * best""")
def t07_candidate_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of a paper scored by keywords and anchors; the runner-up stays if it is close."""
    part = table(spark, sf_dir, "part")
    chapters = part.groupBy(F.col("p_type").alias("paper"), F.col("p_brand").alias("chapter")).agg(F.count("*").cast("double").alias("base"), F.collect_set(F.split("p_name", " ")[0]).alias("words"))
    texts = part.groupBy(F.col("p_type").alias("paper")).agg(F.concat(F.min("p_name"), F.lit(" and "), F.max("p_name")).alias("text"))
    weights = F.array_repeat(F.lit(0.5), F.length("chapter") - 7)
    scored = chapters.join(texts, "paper").withColumn("score", G.boosted(F.col("base"), F.col("text"), F.col("words"), weights, 15.0, 35.0))
    return G.with_runner_up(scored, ["paper"], ["chapter"]).select("paper", "chapter", F.bround("score", 4).alias("score"), "place")


@query("""SELECT o_orderkey, concat_ws(' ', o_orderstatus, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name), c_name, o_orderpriority) AS search_text
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, o_orderstatus, c_name, o_orderpriority""")
def t21_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored text of a question: its fields, its parts in order, its source."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]).alias("names"))
    rows = table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", G.search_text(F.col("o_orderstatus"), F.col("names"), F.col("c_name"), F.col("o_orderpriority")).alias("search_text"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN year(o_orderdate) <> year(l_shipdate) THEN 'year' END, CASE WHEN o_orderstatus <> l_linestatus THEN 'status' END) AS conflicts FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def t24_metadata_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which a hint and what was observed differ."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = G.conflicts([("year", F.year("o_orderdate"), F.year("l_shipdate")), ("status", F.col("o_orderstatus"), F.col("l_linestatus"))])
    return rows.select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("conflicts"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 25")
def f18_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what an extra filter leaves: filtered before the page is cut."""
    disputed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").join(disputed, "o_orderkey", "left_anti")
    return G.page_of(rows, [F.desc_nulls_first("o_totalprice"), "o_orderkey"], 2, 25).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, round_even(count(o_orderkey) * 540 / 3600.0::DOUBLE, 2) AS hours, round_even(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(o_orderkey), 1), 1) AS percent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def m10_review_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review hours at the median of 540 seconds a unit, and the mock score in percent (M16)."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    done = rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return done.select("c_custkey", F.bround(F.col("n") * 540 / 3600.0, 2).alias("hours"), F.bround(F.lit(100.0) * F.col("done") / F.greatest("n", F.lit(1)), 1).alias("percent"))


@query("SELECT user_id, max(event_id) AS revision, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1 HAVING user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def n04_latest_approved_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest descriptor of each node that has an approval."""
    events = table(spark, sf_dir, "events")
    newest = latest(events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("revision"), "value"), ["user_id"], "revision")
    return newest.join(events.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").select("user_id", "revision", "value")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS verifications, count(*) AS events FROM events GROUP BY 1")
def n35_verification_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("verifications"), F.count("*").alias("events"))


@query("""WITH f AS (SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, first_part, coalesce(o_orderkey = max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey), false) AS published FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def n36_revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision with its first event, and which one is published."""
    orders = table(spark, sf_dir, "orders")
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))
    current = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("current"))
    rows = orders.join(first, "o_orderkey", "left").join(current, "o_custkey", "left")
    return rows.select("o_custkey", "o_orderkey", "first_part", F.coalesce(F.col("o_orderkey") == F.col("current"), F.lit(False)).alias("published"))


@query("SELECT DISTINCT p_brand AS chapter, l_orderkey AS appearance, strftime(o_orderdate, '%Y-%m') AS attempt FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def n49_topic_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published appearances tagged on a chapter or below it, each once."""
    tags = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("chapter"), F.col("l_orderkey").alias("appearance")).distinct()
    shown = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("appearance"), F.date_format("o_orderdate", "yyyy-MM").alias("attempt"))
    return tags.join(shown, "appearance")


@query("SELECT p_partkey, p_type, CASE max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'done' WHEN 1 THEN 'in_progress' END AS status FROM part LEFT JOIN events ON user_id = p_partkey WHERE p_size <> 1 GROUP BY ALL")
def n50_applicable_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in scope with their status."""
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    status = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p_partkey")).agg(F.max(kind).alias("best"))
    rows = table(spark, sf_dir, "part").where("p_size != 1").join(status, "p_partkey", "left")
    return rows.select("p_partkey", "p_type", F.when(F.col("best") == 2, "done").when(F.col("best") == 1, "in_progress").alias("status"))


@query("SELECT item_id, substring(text, 1, 120) AS preview FROM benchmark")
def n28_benchmark_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged units with a preview of 120 characters, which is the listing's feature."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 120).alias("preview"))


@query("SELECT a.o_orderkey AS item, a.o_custkey AS reviewer FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = a.o_orderkey AND l_returnflag = 'A') AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') >= 30")
def n29_blind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind reviews joined to frozen suggestions; none below 30 of them."""
    blind = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("reviewer"))
    frozen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("item"))
    enough = blind.agg((F.count("*") >= 30).alias("enough")).where("enough")  # one row
    return blind.join(frozen, "item", "left_semi").join(F.broadcast(enough), F.lit(True)).select("item", "reviewer")
