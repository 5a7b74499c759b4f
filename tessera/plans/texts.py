"""Text and JSON queries over documents, pages, conversations and event properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.functions import text as T
from tessera.operators.retrieval import candidates
from tessera.plans.registry import query
from tessera.sources.stored import stored
from tessera.sources.tables import table


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@query()
def t01_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.collapsed(T.nfkc("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '\d+', '#', 'g')) AS mask FROM documents")
def t02_digit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.masked(F.col("text"))).alias("mask"))


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS total, source FROM documents)"


@query(rf"""WITH {LINES}, edge AS (SELECT *, regexp_replace(lower(line), '\d+', '#', 'g') AS pattern FROM lines WHERE n <= 1 OR n >= total), docs AS (SELECT source, count(*) AS total_docs FROM documents GROUP BY 1),
run AS (SELECT source, pattern FROM edge JOIN docs USING (source) GROUP BY source, pattern, total_docs HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) >= total_docs * 0.02)
SELECT e.source, e.pattern, count(*) AS removed FROM edge e JOIN run USING (source, pattern) GROUP BY ALL""")
def q23_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines whose masked form repeats over a source's documents (2% here, two at least)."""
    rows = docs(spark, sf_dir, "source").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"), F.size(F.split("text", "\n")).alias("total"))
    edge = rows.where("n < 1 or n + 1 >= total").withColumn("pattern", T.masked(F.col("line")))
    size = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total_docs"))
    seen = edge.groupBy("source", "pattern").agg(F.count_distinct("doc_id").alias("d"), F.count("*").alias("removed")).join(size, "source")
    return seen.where("d >= 2 and d >= total_docs * 0.02").select("source", "pattern", "removed")


@query(r"SELECT doc_id, count(*) AS dropped FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[A-ZÀ-Þ][a-zà-ÿ]{0,3}\.$') GROUP BY 1")
def t04_standalone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold one short token and a stop, as page numbers would."""
    return docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^[A-ZÀ-Þ][a-zà-ÿ]{0,3}\.$")).groupBy("doc_id").agg(F.count("*").alias("dropped"))


@query()
def t05_fuzzy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy scores of each benchmark item and the same-numbered document, whole texts both."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    rows = docs(spark, sf_dir).join(items, "doc_id")
    return rows.select("doc_id", T.partial_ratio("item", "text").alias("partial"), T.token_set_ratio("item", "text").alias("token_set"))


TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: regexp_full_match(x, '[a-z][a-z0-9]{3,}') AND x NOT IN ('that', 'this', 'with', 'from', 'have', 'will', 'which', 'their', 'there', 'been', 'were'))"


@query()
def t09_candidate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates among documents of all languages: the 40 of each item with most token overlap + 10 x phrase hits.

    The tables have no lists of terms, so a phrase is two retrieval tokens side by side; one that both hold is a hit.
    """
    marked = lambda rows, key: rows.select(key, T.retrieval_tokens(F.col("text")).alias("marked"))
    elements = lambda rows, key: marked(rows, key).select(key, F.concat(T.tokens(F.col("marked")), T.phrases(F.col("marked"))).alias("elements"))
    rows = docs(spark, sf_dir)
    held = stored(spark, "documents-elements-1", [rows], lambda: elements(rows, "doc_id"))
    return candidates(elements(table(spark, sf_dir, "benchmark"), "item_id"), held, 40, "item_id", "doc_id")


@query("SELECT doc_id, CASE n WHEN 0 THEN 'none_fits' WHEN 1 THEN 'matched' ELSE 'needs_review' END AS outcome FROM (SELECT doc_id, CAST(regexp_matches(text, '(^|[^\\w])the(\\W|$)') AS INT) + CAST(regexp_matches(text, '(^|[^\\w])der(\\W|$)') AS INT) + CAST(regexp_matches(text, '(^|[^\\w])les(\\W|$)') AS INT) + CAST(regexp_matches(text, '(^|[^\\w])los(\\W|$)') AS INT) AS n FROM documents)".replace("\\W|$", "[^\\w]|$"))
def t11_phrase_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-phrase matches of four terms: none, one or an ambiguity."""
    n = sum((T.whole_phrase(F.col("text"), p).cast("int") for p in ("the", "der", "les", "los")), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", F.when(n == 0, "none_fits").when(n == 1, "matched").otherwise("needs_review").alias("outcome"))


@query(r"SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')), ' '), 1, 25), ' ') || CASE WHEN len(string_split(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')), ' ')) > 25 THEN '...' ELSE '' END AS gist FROM documents")
def t15_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.gist(F.col("text")).alias("gist"))


@query(r"SELECT doc_id, sha1(concat_ws('|', source, lang, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))) AS fingerprint FROM documents")
def t16_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-1 of source, language and folded text; a null source or language is left out of the joined text."""
    return docs(spark, sf_dir, "source", "lang").select("doc_id", T.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS digest FROM customer""")
def t17_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.canonical_digest("c_name", "c_custkey", "c_mktsegment").alias("digest"))


@query(r"SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text_key, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def t19_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded texts that occur more than once; null texts repeat nothing."""
    key = F.sha2(F.lower(T.collapsed(F.col("text"))), 256)
    rows = docs(spark, sf_dir).where("text is not null").groupBy(key.alias("text_key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return rows.where("copies > 1")


@query()
def t22_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(T.links("html", "url")).alias("n", "link"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url LIKE 'https://%' AND regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) LIKE '%.example.com' AS official FROM pages")
def f17_official_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host, scheme = F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("PROTOCOL"))
    return table(spark, sf_dir, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), ((scheme == "https") & host.endswith(".example.com")).alias("official"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.missing') IS NULL THEN 'absent' ELSE 'number' END AS other FROM events")
def x01_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", N.path(props, "k", "long").alias("k"), N.json_kind(props, "missing").alias("other"))


@query("SELECT CASE WHEN json_type(json_extract(props, '$.k')) NOT IN ('UBIGINT', 'BIGINT') THEN 'invalid_type' WHEN k > 90 THEN 'out_of_range' WHEN k < 50 THEN '[0,50)' ELSE '[50,90]' END AS label, count(*) AS n FROM (SELECT props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def a14_confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram over a JSON value by its type and range."""
    props, k = F.col("props"), N.path(F.col("props"), "k", "long")
    kind = N.json_kind(props, "k")
    label = F.when(kind == "absent", "absent").when(kind != "number", "invalid_type").when(k > 90, "out_of_range").when(k < 50, "[0,50)").otherwise("[50,90]")
    return table(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, len(list(l_partkey)) AS parts, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity >= 5) AS all_large FROM lineitem GROUP BY 1")
def x13_nested_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any and all over an array of structs."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    return rows.select("l_orderkey", F.size("items").cast("long").alias("parts"), F.exists("items", lambda x: x["l_returnflag"] == "R").alias("any_returned"), F.forall("items", lambda x: x["l_quantity"] >= 5).alias("all_large"))


@query("""WITH m AS (SELECT conv_id, count(*) - 1 AS n FROM conversations GROUP BY 1) SELECT conv_id, 'primary' AS role, 1 AS nodes, round_even(1 / (1 + 0.5::DOUBLE * n), 9) AS share FROM m UNION ALL SELECT conv_id, 'secondary', n, round_even(0.5::DOUBLE * n / (1 + 0.5::DOUBLE * n), 9) FROM m WHERE n > 0""")
def x12_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary 1, secondary one half each, normalised; summed by role."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    shares = rows.select("conv_id", F.explode(N.split_shares(F.col("turns")[0], F.slice("turns", 2, 1_000_000))).alias("s"))
    return shares.groupBy("conv_id", F.col("s.role").alias("role")).agg(F.count("*").alias("nodes"), F.bround(F.sum("s.share"), 9).alias("share"))


@query("SELECT event_id, [1, 3, 7, 14, 30][least(k, 4) + 1] AS days FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS k FROM events)")
def x11_clamped_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(N.path(F.col("props"), "k", "long") / 10)
    return table(spark, sf_dir, "events").select("event_id", N.clamped([1, 3, 7, 14, 30], k).alias("days"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'not_fulfilled' END, CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' END, CASE WHEN o_totalprice < 20000 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_totalprice >= 20000")
def f14_ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that holds, in order, distinct."""
    price = F.col("o_totalprice")
    found = N.blockers(("not_fulfilled", F.col("o_orderstatus") != "F"), ("small", price < 50000), ("low", F.col("o_orderpriority") == "5-LOW"), ("small", price < 20000))
    return table(spark, sf_dir, "orders").where("o_totalprice >= 20000").select("o_orderkey", F.array_join(found, ",").alias("reasons"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)all rights reserved') AND NOT regexp_matches(text, '!!') AND source LIKE 'src1%'")
def f06_regex_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "source").where(F.col("text").rlike("(?i)all rights reserved") & ~F.col("text").rlike("!!") & F.col("source").like("src1%")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\\x{0900}-\\x{097F}]') AND source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 30000)")
def f09_language_opt_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a script, and without the sources of certain titles."""
    barred = table(spark, sf_dir, "documents").where("lang = 'es' and n_chars > 30000").select("source")
    return docs(spark, sf_dir, "source").where(~F.col("text").rlike(r"[\x{0900}-\x{097F}]")).join(barred, "source", "left_anti").select("doc_id")


@query("SELECT id FROM (SELECT 'P' || (p_size % 8 + 1) || '-' || upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6)) AS id FROM part) WHERE regexp_matches(id, '^P[1-6]-[0-9A-HJKMNP-TV-Z]{6}$')")
def t28_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("P"), (F.col("p_size") % 8 + 1).cast("string"), F.lit("-"), F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)))
    return table(spark, sf_dir, "part").select(node.alias("id")).where(F.col("id").rlike("^P[1-6]-[0-9A-HJKMNP-TV-Z]{6}$"))
