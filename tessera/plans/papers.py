"""Papers read line by line: orders as papers whose lines derive from their order lines, and their units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import segmentation as G
from tessera.plans.registry import query
from tessera.sources.tables import partitions, table

PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")


def paper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, n, page, text: an order line asks a question in parts, some with an alternative, a subpart or an answer."""
    lines = table(spark, sf_dir, "lineitem").repartition(partitions(spark, sf_dir, "lineitem"), "l_orderkey")
    rows = lines.withColumn("ln", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PLACE)))
    marks = lambda c: F.concat(F.lit("("), F.pmod(F.col(c).cast("long"), F.lit(9)).cast("string"), F.lit(" marks)"))
    either, answered = F.col("l_linestatus") == "F", F.col("l_returnflag") != "N"
    text = F.array(
        F.when(F.col("ln") == 1, "Section A").when(F.col("ln") == 5, "Section B"),
        F.concat(F.lit("Question "), (F.col("l_partkey") % 3).cast("string"), F.lit(" on "), F.col("l_partkey").cast("string")),
        F.concat(F.lit("(a) Explain "), marks("l_suppkey")),
        F.when(either, "OR"),
        F.concat(F.when(either, "(a) Instead ").otherwise("(b) Also "), marks("l_quantity")),
        F.when(F.col("l_returnflag") == "R", "(i) First (2 marks)"),
        F.when(answered, "Answer"),
        F.when(answered, F.concat(F.lit("(a) Because of "), F.col("l_suppkey").cast("string"))),
    )
    found = rows.select(F.col("l_orderkey").alias("doc"), "ln", F.posexplode(text).alias("k", "text")).where("text is not null")
    return found.select("doc", (F.col("ln") * 10 + F.col("k")).cast("int").alias("n"), F.ceil(F.col("ln") / 2).cast("int").alias("page"), "text")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}) AS ln FROM lineitem),
q AS (SELECT l_orderkey AS doc, ln, (CASE WHEN ln < 5 THEN 'SA' ELSE 'SB' END) || '.Q' || l_partkey % 3 AS base, l_linestatus = 'F' AS either, l_returnflag AS flag, l_partkey AS about, l_suppkey AS why,
  l_suppkey % 9 AS m1, CAST(l_quantity AS BIGINT) % 9 AS m2, count(*) FILTER (WHERE l_linestatus = 'F') OVER (PARTITION BY l_orderkey ORDER BY ln) AS ors FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY ln) AS nth FROM q),
p AS (SELECT *, base || CASE WHEN nth > 1 THEN '.repeat' || nth ELSE '' END AS path, (ln + 1) // 2 AS page, CASE WHEN flag = 'R' THEN 2 ELSE m2 END AS second FROM r),
u AS (
  SELECT doc, path AS label_path, 'question' AS kind, NULL AS parent, page, ln * 10 + 1 AS first_line, ln * 10 + 1 AS last_line, CASE WHEN either THEN greatest(m1, second) ELSE m1 + second END AS marks, 'summed' AS marks_source, NULL AS or_group,
    'Question ' || about % 3 || ' on ' || about AS asked, '' AS answered FROM p
  UNION ALL SELECT doc, path || '.a', 'part', path, page, ln * 10 + 2, CASE WHEN flag = 'N' THEN ln * 10 + 2 ELSE ln * 10 + 7 END, m1, 'explicit', CASE WHEN either THEN path || '.or' || ors END,
    '(a) Explain (' || m1 || ' marks)', CASE WHEN flag = 'N' THEN '' ELSE '(a) Because of ' || why END FROM p
  UNION ALL SELECT doc, path || CASE WHEN either THEN '.a.alt2' ELSE '.b' END, 'part', path, page, ln * 10 + 4, ln * 10 + 4, second, CASE WHEN flag = 'R' THEN 'summed' ELSE 'explicit' END, CASE WHEN either THEN path || '.or' || ors END,
    CASE WHEN either THEN '(a) Instead (' ELSE '(b) Also (' END || m2 || ' marks)', '' FROM p
  UNION ALL SELECT doc, path || CASE WHEN either THEN '.a.alt2.i' ELSE '.b.i' END, 'subpart', path || CASE WHEN either THEN '.a.alt2' ELSE '.b' END, page, ln * 10 + 5, ln * 10 + 5, 2, 'explicit', NULL, '(i) First (2 marks)', '' FROM p WHERE flag = 'R')
SELECT doc, label_path, kind, parent, CAST(page AS INT) AS page_start, CAST(page AS INT) AS page_end, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, CAST(marks AS INT) AS marks, marks_source, or_group,
  sha256(asked || chr(10) || answered) AS content_digest FROM u""")
def d06_paper_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit tree of every paper: labels, pages, lines, marks rolled up over OR groups, and digests of question and answer."""
    rows = G.units(paper_lines(spark, sf_dir))
    return rows.select("doc", "label_path", "kind", "parent", "page_start", "page_end", "first_line", "last_line", "marks", "marks_source", "or_group", "content_digest")
