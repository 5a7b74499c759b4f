"""Extraction, catalogue, release and curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.functions import nested as N
from tessera.operators.windows import latest
from tessera.plans.registry import query
from tessera.sources.tables import table


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as references: a paper code and a sentence with anchors."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat(F.lit("Under Ind AS "), size, F.lit(" and SA "), (key % 900 + 100).cast("string"), F.lit("; section "), size, F.when(key % 3 == 0, " of the IGST Act").otherwise(" applies"))
    return table(spark, sf_dir, "part").select(key.alias("part"), F.concat(F.lit("P"), (key % 6 + 1).cast("string")).alias("paper"), text.alias("text"))


@query("""WITH t AS (SELECT p_partkey AS part, 'P' || (p_partkey % 6 + 1) AS paper, p_size AS s, p_partkey % 900 + 100 AS sa, CASE WHEN p_partkey % 3 = 0 THEN 'IGST' ELSE 'CGST' END AS act FROM part)
SELECT part, 'IndAS' AS instrument, CAST(s AS VARCHAR) AS ref_key FROM t WHERE paper IN ('P1', 'P6') UNION ALL SELECT part, 'SA', CAST(sa AS VARCHAR) FROM t WHERE paper IN ('P3', 'P6') AND sa < 1000
UNION ALL SELECT part, 'ITA1961', CAST(s AS VARCHAR) FROM t WHERE paper IN ('P4', 'P6') UNION ALL SELECT part, act, CAST(s AS VARCHAR) FROM t WHERE paper IN ('P5', 'P6')""")
def t08_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(spark, sf_dir).select("part", F.explode(X.anchors(F.col("text"), F.col("paper"))).alias("a"))
    return rows.select("part", "a.instrument", "a.ref_key")


@query("""WITH n AS (SELECT o_orderkey, 'Paper ' || (o_orderkey % 6 + 1) || CASE WHEN o_orderkey % 4 = 0 THEN ' paper 7' ELSE '' END || CASE o_orderkey % 3 WHEN 0 THEN ' Mock Test Paper ' WHEN 1 THEN ' Suggested Answer ' ELSE ' notes ' END || strftime(o_orderdate, '%b %Y') AS name FROM orders)
SELECT n.o_orderkey, strftime(o_orderdate, '%Y-%m') AS attempt, CASE WHEN n.o_orderkey % 4 <> 0 THEN 'P' || (n.o_orderkey % 6 + 1) END AS paper, CASE n.o_orderkey % 3 WHEN 0 THEN 'mtp_question' WHEN 1 THEN 'suggested_answer' END AS doc_type FROM n JOIN orders USING (o_orderkey)""")
def t20_inferred_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue facets from a file's name."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("Paper "), (key % 6 + 1).cast("string"), F.when(key % 4 == 0, " paper 7").otherwise(""), F.when(key % 3 == 0, " Mock Test Paper ").when(key % 3 == 1, " Suggested Answer ").otherwise(" notes "), F.date_format("o_orderdate", "MMM yyyy"))
    rows = table(spark, sf_dir, "orders").select(key, name.alias("name"))
    return rows.select("o_orderkey", X.attempt_of(F.col("name")).alias("attempt"), X.paper_of(F.col("name")).alias("paper"), X.doc_type_of(F.col("name")).alias("doc_type"))


@query("""WITH p AS (SELECT regexp_extract(p_brand, '(\\d+)', 1) AS number, p_brand, p_partkey, p_size, p_name, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) * 1000000 + p_partkey // 500 AS doc_id FROM part)
SELECT doc_id, 0 AS n, 'chapter' AS kind, number, any_value(p_brand) AS title, CAST(NULL AS VARCHAR) AS reference, CAST(NULL AS INT) AS parent, false AS missing_prefix FROM p GROUP BY doc_id, number
UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey) AS INT), 'topic', number || '.' || p_size, p_name, CAST(p_partkey AS VARCHAR), 0, true FROM p""")
def t25_contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages made from parts: one of at most 500 keys of a brand, a chapter heading with numbered topics below."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    part = table(spark, sf_dir, "part").withColumn("number", number).withColumn("doc_id", number.cast("long") * 1_000_000 + F.floor(F.col("p_partkey") / 500))
    lines = part.select("doc_id", F.col("p_partkey").cast("long").alias("line_no"), F.concat("number", F.lit("."), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" ..... "), F.col("p_partkey").cast("string")).alias("line"))
    heads = part.groupBy("doc_id", "number", "p_brand").agg(F.lit(-1).cast("long").alias("line_no")).select("doc_id", "line_no", F.concat(F.lit("Chapter "), "number", F.lit(": "), "p_brand").alias("line"))
    return X.contents(heads.unionByName(lines))


@query("SELECT o_orderkey, o_custkey % 5 = 0 AND month(o_orderdate) < 6 OR o_custkey % 7 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 3) AS stale FROM orders")
def m15_law_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a boundary of the paper: everywhere, or where the boundary's scope covers a tagged topic."""
    scoped = table(spark, sf_dir, "lineitem").where("l_partkey % 10 = 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    rows = table(spark, sf_dir, "orders").join(scoped, "o_orderkey", "left")
    stale = ((F.col("o_custkey") % 5 == 0) & (F.month("o_orderdate") < 6)) | ((F.col("o_custkey") % 7 == 0) & F.coalesce("hit", F.lit(False)))
    return rows.select("o_orderkey", stale.alias("stale"))


@query("SELECT user_id, round_even(date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600.0::DOUBLE, 2) AS age_hours, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') > 48 * 3600 AS stale FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def m17_age_and_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(seconds.alias("s"))
    return rows.select("user_id", F.bround(F.col("s") / 3600.0, 2).alias("age_hours"), (F.col("s") > 48 * 3600).alias("stale"))


@query("SELECT p_brand AS topic, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'N') AS decided, count(*) FILTER (WHERE l_returnflag = 'A') AS matched, CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'N') = 0 THEN 'no data' WHEN count(*) FILTER (WHERE l_returnflag <> 'N') < 30 THEN 'too few' WHEN count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE / count(*) FILTER (WHERE l_returnflag <> 'N') >= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a21_benchmark_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("topic")), F.col("l_partkey") == F.col("p_partkey"))
    n = rows.groupBy("topic").agg(F.count("*").alias("total"), F.count_if(flag != "N").alias("decided"), F.count_if(flag == "A").alias("matched"))
    return n.withColumn("status", F.when(F.col("decided") == 0, "no data").when(F.col("decided") < 30, "too few").when(F.try_divide("matched", "decided") >= 0.5, "pass").otherwise("fail"))


@query("SELECT k, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (SELECT event_type, unnest([CAST(json_extract(props, '$.k') AS BIGINT), user_id % 7]) AS k FROM events) GROUP BY 1")
def a23_unnested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(F.array(N.path(F.col("props"), "k", "long"), F.col("user_id") % 7)).alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS attempt, count(*) AS documents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS verified, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS reasons FROM orders WHERE strftime(o_orderdate, '%Y') NOT IN ('1995', '1996') GROUP BY ALL")
def a26_ledger_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ledger rows for contexts that have none yet."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("attempt"))
    seeded = rows.agg(F.count("*").alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("verified"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("reasons"))
    known = spark.createDataFrame([("1995",), ("1996",)], "attempt string")
    return seeded.join(known, "attempt", "left_anti")


@query("SELECT doc_id FROM documents d WHERE n_chars >= 200 AND lang IN ('en', 'de') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM documents e JOIN labels l USING (doc_id) WHERE toxic = 1 AND e.source = d.source AND e.lang = d.lang)")
def q13_classification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsuggested units whose context has no open gap."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    gaps = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").select("source", "lang")
    return docs.where("n_chars >= 200 and lang in ('en', 'de')").join(labels.select("doc_id"), "doc_id", "left_anti").join(gaps, ["source", "lang"], "left_anti").select("doc_id")


@query("SELECT 'orders without lines' AS finding, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'repeated line labels', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'repeated texts', count(*) FROM (SELECT 1 FROM documents GROUP BY md5(text) HAVING count(*) > 1) UNION ALL SELECT 'unlabelled documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q15_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, docs = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "documents")
    repeated = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1")
    found = {
        "orders without lines": table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "repeated line labels": repeated(lines, "l_orderkey", "l_linenumber"), "repeated texts": repeated(docs, F.md5("text")),
        "unlabelled documents": docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti"),
    }
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n") for name, rows in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT p_type AS release, p_brand AS chapter, count(*) AS members, count(*) FILTER (WHERE p_size % 5 <> 0) AS supported, bool_and(p_size % 25 <> 0) AS complete FROM part GROUP BY ALL HAVING count(*) > 1")
def q20_release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    n = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("release"), F.col("p_brand").alias("chapter")).agg(F.count("*").alias("members"), F.count_if(size % 5 != 0).alias("supported"), F.bool_and(size % 25 != 0).alias("complete"))
    return n.where("members > 1")


@query("SELECT c_custkey, o_orderkey AS revision FROM (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.o_orderkey AND l_returnflag = 'A')")
def q21_pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each descriptor, where it has no approval."""
    last = latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("revision"), "o_orderdate"), ["c_custkey"], "revision")
    approved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("revision"))
    return last.select("c_custkey", "revision").join(approved, "revision", "left_anti").select("c_custkey", "revision")


@query("""WITH p AS (SELECT l_orderkey, sum(l_quantity) AS offered, bool_or(l_linenumber = 7) AS has_choice, count(*) AS leaves FROM lineitem GROUP BY 1)
SELECT l_orderkey, leaves, offered, CASE WHEN NOT has_choice THEN offered END AS attributed, o_totalprice < 30000 AND leaves > 3 AS over_bound FROM p JOIN orders ON l_orderkey = o_orderkey""")
def q26_marks_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered marks stand; a choice voids their attribution; parts are held against their parent."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("offered"), F.bool_or(F.col("l_linenumber") == 7).alias("has_choice"), F.count("*").alias("leaves"))
    rows = n.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "leaves", "offered", F.when(~F.col("has_choice"), F.col("offered")).alias("attributed"), ((F.col("o_totalprice") < 30000) & (F.col("leaves") > 3)).alias("over_bound"))


@query("SELECT l_orderkey, l_linenumber, rn, rn = 1 AS is_primary, round_even(CASE WHEN rn = 1 THEN 1 ELSE 0.5::DOUBLE END / (1 + 0.5::DOUBLE * (n - 1)), 9) AS share FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)")
def n34_appearance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of a part become shared tags: the first primary, the rest secondary."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list("l_partkey")).alias("nodes"))
    each = rows.select("l_orderkey", "l_linenumber", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    share = F.when(F.col("pos") == 0, 1.0).otherwise(0.5) / (1 + 0.5 * (F.col("n") - 1))
    return each.select("l_orderkey", "l_linenumber", (F.col("pos") + 1).cast("long").alias("rn"), (F.col("pos") == 0).alias("is_primary"), F.bround(share, 9).alias("share"))


@query("SELECT k, array_to_string(list_sort(list_distinct(list(tag))), ',') AS sources FROM (SELECT o_custkey AS k, o_orderpriority AS tag FROM orders UNION ALL SELECT user_id, event_type FROM events) GROUP BY 1")
def n13_association_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert where absent, else add the association."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("a"))
    new = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.collect_set("event_type").alias("b"))
    none = F.array().cast("array<string>")
    return old.join(new, "k", "full_outer").select("k", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), ",").alias("sources"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey <> o_custkey + (o_orderkey % 5 = 0)::INT THEN 'o_custkey' END, CASE WHEN o_orderkey % 7 = 0 THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS differs FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def n14_import_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known rows of an import with the names of the fields that differ."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = old.select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("c"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("p"))
    both = old.join(new, "o_orderkey").withColumn("d", N.blockers(("o_custkey", ~F.col("o_custkey").eqNullSafe(F.col("c"))), ("o_orderpriority", ~F.col("o_orderpriority").eqNullSafe(F.col("p")))))
    return both.where(F.size("d") > 0).select("o_orderkey", F.array_join("d", ",").alias("differs"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red %' AND list_has_all(string_split(p_name || ' ' || p_type, ' '), ['red', 'SMALL'])")
def n30_feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have every wanted feature."""
    features = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    wanted = F.array(F.lit("red"), F.lit("SMALL"))
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("red ") & (F.size(F.array_except(wanted, features)) == 0)).select("p_partkey", "p_name")


@query("SELECT sha256(concat_ws('|', o_custkey, strftime(o_orderdate, '%Y-%m'), o_orderpriority, n)) AS identity, CASE WHEN n = 1 THEN 'confirmed' ELSE 'ambiguous' END AS state, count(*) AS occurrences FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m'), o_orderpriority) AS n FROM orders) GROUP BY ALL")
def n31_occurrence_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest names an occurrence; it is confirmed where one document bears it."""
    by = [F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderpriority")]
    n = table(spark, sf_dir, "orders").groupBy(by[0].alias("a"), by[1].alias("b"), by[2].alias("c")).agg(F.count("*").alias("n"))
    return n.select(F.sha2(F.concat_ws("|", "a", "b", "c", F.col("n").cast("string")), 256).alias("identity"), F.when(F.col("n") == 1, "confirmed").otherwise("ambiguous").alias("state"), F.col("n").alias("occurrences"))


@query("SELECT conv_id, turn, sha256(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn) || '|' || text) AS digest FROM conversations")
def n22_inherited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's digest over the roles that lead to it and its own text."""
    context = F.array_join(F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn")), ">")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat(context, F.lit("|"), F.col("text")), 256).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN upper(role) ELSE role END AS role FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn >= 2)")
def n18_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches replace a field; a deletion takes the unit's subtree with it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    patches = turns.where("turn % 4 = 1").select("conv_id", "turn", F.upper("role").alias("patched"))
    cut = turns.where("conv_id % 3 = 0").select("conv_id").distinct().withColumn("from_turn", F.lit(2))
    kept = turns.join(cut, (turns["conv_id"] == cut["conv_id"]) & (F.col("turn") >= F.col("from_turn")), "left_anti")
    return kept.join(patches, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("patched", "role").alias("role"))


@query("SELECT p_partkey, (SELECT count(*) FROM supplier WHERE p_partkey >= s_nationkey * 40 AND p_partkey + p_size <= s_nationkey * 40 + 40) AS inside FROM part")
def n10_spans_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that lie within a source's pages: containment through buckets of the sources' width."""
    parts = table(spark, sf_dir, "part")
    pages = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") * 40).cast("long").alias("first")).agg(F.count("*").alias("c"))
    spans = parts.select("p_partkey", "p_size", (F.floor(F.col("p_partkey") / 40) * 40).alias("low"))
    tries = spans.select("p_partkey", "p_size", F.explode(F.array("low", F.col("low") - 40)).alias("first"))
    found = tries.join(pages, "first", "left").withColumn("hit", F.when((F.col("p_partkey") >= F.col("first")) & (F.col("p_partkey") + F.col("p_size") <= F.col("first") + 40), F.coalesce("c", F.lit(0))).otherwise(0))
    return found.groupBy("p_partkey").agg(F.sum("hit").alias("inside"))


@query("SELECT o_orderkey, CASE WHEN m.k IS NULL THEN o_orderkey ELSE m.k END AS pointer FROM orders LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS k FROM lineitem GROUP BY 1) m ON m.l_partkey = o_custkey AND m.k <> o_orderkey")
def j20_pointer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update from a join, as a new pointer column."""
    target = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("o_custkey")).agg(F.min("l_orderkey").alias("k"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(target, "o_custkey", "left")
    return rows.select("o_orderkey", F.when(F.col("k") != F.col("o_orderkey"), F.col("k")).otherwise(F.col("o_orderkey")).alias("pointer"))


@query("SELECT p_partkey, coalesce(e, -1) AS shown FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS e FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON l_partkey = p_partkey ORDER BY shown DESC, p_partkey LIMIT 30")
def o05_top_k_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored rows show -1 and come last."""
    best = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("e"))
    return table(spark, sf_dir, "part").select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", F.coalesce("e", F.lit(-1.0)).alias("shown")).orderBy(F.desc("shown"), "p_partkey").limit(30)


@query("SELECT conv_id, array_to_string(list_distinct_in_order, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first) AS list_distinct_in_order FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY 1)")
def u04_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def x02_object_in_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array that holds an object with these fields."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("o"))
    return rows.where(F.exists("o", lambda x: (x["o_orderstatus"] == "F") & (x["o_orderpriority"] == "1-URGENT"))).select("o_custkey")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS row FROM nation""")
def x08_row_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row"))


@query("WITH s AS (SELECT o_custkey, list_sort(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS a, list_sort(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O')) AS b FROM orders GROUP BY 1) SELECT o_custkey, coalesce(a, []) = coalesce(b, []) AS same FROM s")
def x15_canonical_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((side("F") == side("O")).alias("same"))


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def f10_scope_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the active release and in no other."""
    part = table(spark, sf_dir, "part")
    active = part.where("p_size = 7").select("p_brand")
    other = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return part.select("p_partkey", "p_brand").join(active, "p_brand", "left_semi").join(other, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag IN ('A', 'N'))")
def f13_all_dimensions_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "N", "not_applicable").otherwise("concern")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(state).alias("states"))
    return rows.where(N.all_ready(F.col("states"))).select("l_orderkey")
