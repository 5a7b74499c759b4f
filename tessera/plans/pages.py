"""Paged lines: customers as documents, their orders as pages, line items as lines from top to bottom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import furniture
from tessera.plans.registry import query
from tessera.sources.tables import table

PAGED_SQL = """n AS (SELECT l_orderkey AS page, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS INT) AS q, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
lines AS (SELECT o_custkey AS doc, page, k, 1000.0::DOUBLE AS height, CASE WHEN n = 1 THEN 0.0 ELSE 1000.0 * (k - 1) / (n - 1) END::DOUBLE AS y,
  CASE WHEN flag = 'R' AND status = 'F' THEN '(b) Paper ' || q WHEN status = 'O' THEN 'Page ' || q || ' of 50' ELSE 'Final Course Paper ' || (q % 3) END AS text FROM n JOIN orders ON o_orderkey = page),
size AS (SELECT doc, count(DISTINCT page) AS n_pages FROM lines GROUP BY 1),
marked AS (SELECT *, regexp_matches(text, '^\\([a-h]\\)') AS protected, regexp_replace(lower(text), '\\d+', '#', 'g') AS pattern, y <= 0.08::DOUBLE * height OR y >= 0.92::DOUBLE * height AS narrow, y <= 0.1::DOUBLE * height OR y >= 0.9::DOUBLE * height AS wide FROM lines),
run AS (SELECT doc, pattern, count(DISTINCT page) AS on_pages FROM marked JOIN size USING (doc) WHERE narrow AND NOT protected GROUP BY doc, pattern, n_pages HAVING n_pages > 1 AND count(DISTINCT page) >= greatest(2, n_pages // 2)),
roles AS (SELECT m.*, CASE WHEN protected THEN 'content' WHEN narrow AND r.doc IS NOT NULL THEN 'running' WHEN wide AND n_pages > 1 AND text LIKE 'Page%' THEN 'page_number' ELSE 'content' END AS role FROM marked m JOIN size USING (doc) LEFT JOIN run r ON r.doc = m.doc AND r.pattern = m.pattern)"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, k, height, y, text of all line items."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    q = F.col("l_quantity").cast("int")
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    text = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.concat(F.lit("(b) Paper "), q)).when(F.col("l_linestatus") == "O", F.concat(F.lit("Page "), q, F.lit(" of 50"))).otherwise(F.concat(F.lit("Final Course Paper "), q % 3))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("k"), n.alias("n"), text.alias("text"))
    y = F.when(F.col("n") == 1, 0.0).otherwise(1000.0 * (F.col("k") - 1) / (F.greatest("n", F.lit(2)) - 1))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    return rows.join(orders, "l_orderkey").select("doc", F.col("l_orderkey").alias("page"), "k", F.lit(1000.0).alias("height"), y.alias("y"), "text")


@query(f"WITH {PAGED_SQL} SELECT doc, pattern, on_pages AS n_pages FROM run")
def t03_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers: masked lines in the outer 8 % of at least half a document's pages."""
    return furniture.running_lines(paged(spark, sf_dir))


@query(f"WITH {PAGED_SQL} SELECT doc, page, k, text FROM roles WHERE role = 'content'")
def t03_cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines but running headers, footers and page numbers; those that open content stay."""
    return furniture.cleaned(paged(spark, sf_dir)).select("doc", "page", "k", "text")


@query(f"WITH {PAGED_SQL} SELECT doc, count(*) AS dropped FROM roles WHERE role = 'page_number' GROUP BY 1")
def t04_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone page numbers in the outer 10 %, which no running line takes already."""
    return furniture.classified(paged(spark, sf_dir)).where("role = 'page_number'").groupBy("doc").agg(F.count("*").alias("dropped"))
