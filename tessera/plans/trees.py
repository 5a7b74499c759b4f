"""Tree queries over the paper, chapter, leaf hierarchy and the region, nation, customer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tree as T
from tessera.plans import model as M
from tessera.plans.registry import query
from tessera.sources.tables import table

REC = f"WITH RECURSIVE {M.NODES_SQL}"


def closed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = M.nodes(spark, sf_dir)
    return nodes, T.closure(nodes)


@query(f"{REC} SELECT ancestor, id, CAST(depth AS INT) AS depth FROM closure")
def r01_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed(spark, sf_dir)[1].select("ancestor", "id", F.col("depth").cast("int").alias("depth"))


@query(f"{REC} SELECT id, string_agg(ancestor, '/' ORDER BY depth DESC) AS path FROM closure GROUP BY id")
def r01_ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chains(closed(spark, sf_dir)[1])


@query(f"{REC} SELECT c.id, arg_min(c.ancestor, c.depth) AS ancestor FROM closure c JOIN nodes n ON n.id = c.ancestor AND n.level = 'chapter' GROUP BY c.id")
def r02_nearest_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, closure = closed(spark, sf_dir)
    return T.ancestor_at(closure, nodes, "chapter")


LEAVES = "leaf AS (SELECT id FROM nodes n WHERE level = 'subtopic' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.id))"


@query(f"{REC}, {LEAVES} SELECT ancestor, id FROM closure WHERE id IN (SELECT id FROM leaf) AND ancestor <> id")
def r03_descendant_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, closure = closed(spark, sf_dir)
    return T.descendant_leaves(closure, T.leaves(nodes, "subtopic")).where("ancestor != id")


EXCLUDED = "out AS (SELECT id FROM nodes WHERE level = 'chapter' AND seq = 13 OR level = 'subtopic' AND seq = 1)"


@query(f"{REC}, {EXCLUDED} SELECT id, level FROM nodes n WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM closure c JOIN out o ON o.id = c.ancestor WHERE c.id = n.id)")
def r04_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions pass down; retired nodes go."""
    nodes, closure = closed(spark, sf_dir)
    return T.applicable(closure, nodes, nodes.where("level = 'chapter' and seq = 13 or level = 'subtopic' and seq = 1")).select("id", "level")


@query(f"{REC} SELECT DISTINCT ancestor AS id FROM closure WHERE id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 49)")
def r05_upward_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes reached upward from tagged leaves."""
    start = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("id")).distinct()
    return closed(spark, sf_dir)[1].join(start, "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()


@query(f"{REC}, {LEAVES}, {EXCLUDED} SELECT l.id FROM leaf l JOIN nodes n USING (id) WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM closure c JOIN out o ON o.id = c.ancestor WHERE c.id = l.id)")
def r06_leaves_before_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the whole tree, then filtered: a container whose children all go is no leaf."""
    nodes, closure = closed(spark, sf_dir)
    kept = T.applicable(closure, nodes, nodes.where("level = 'chapter' and seq = 13 or level = 'subtopic' and seq = 1"))
    return T.leaves(nodes, "subtopic").join(kept.select("id"), "id", "left_semi").select("id")


@query(f"{REC} SELECT id FROM closure c JOIN nodes n ON n.id = c.ancestor GROUP BY c.id HAVING bool_and(n.seq % 4 <> 3)".replace("SELECT id FROM closure", "SELECT c.id FROM closure"))
def r07_every_ancestor_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, closure = closed(spark, sf_dir)
    return T.all_supported(closure, nodes.where("seq % 4 != 3").select("id"))


@query("SELECT p_type AS paper, p_brand AS chapter, count(*) AS topics, count(DISTINCT p_size) AS sizes, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS children FROM part GROUP BY ALL")
def r08_tree_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with their ordered children and counts."""
    child = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("paper"), F.col("p_brand").alias("chapter")).agg(
        F.count("*").alias("topics"), F.count_distinct("p_size").alias("sizes"), F.array_join(F.transform(child, lambda x: x["p_partkey"].cast("string")), ",").alias("children")
    )


@query("""SELECT r_name AS region, n_name AS nation, count(c_custkey) AS customers, round_even(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def r09_projection_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    per = customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    rows = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.bround("balance", 2).alias("balance"))


@query(f"""{REC}, keyed AS (SELECT c.id, list({{'seq': n.seq, 'id': n.id}} ORDER BY c.depth DESC) AS k FROM closure c JOIN nodes n ON n.id = c.ancestor GROUP BY c.id)
SELECT id, row_number() OVER (ORDER BY k) AS position FROM keyed""")
def r10_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first order by (seq, id) at every level."""
    nodes, closure = closed(spark, sf_dir)
    keyed = T.preorder_keys(closure, nodes)
    return T.positions(keyed, ["k"]).select("id", F.col("position").cast("long").alias("position"))


@query("""WITH RECURSIVE link AS (SELECT l_orderkey AS id, max(l_partkey) AS old FROM lineitem GROUP BY 1), chain AS (SELECT id, id AS origin, 0 AS hops FROM link UNION ALL SELECT c.id, l.old, hops + 1 FROM chain c JOIN link l ON c.origin = l.id WHERE l.old < c.origin)
SELECT id, arg_max(origin, hops) AS origin, CAST(max(hops) AS INT) AS hops FROM chain GROUP BY id""")
def r11_supersession_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer chase to each document's origin; a pointer only leads to a smaller id, so chains end.

    Pointers jump in doubling steps until none moves: rounds grow with the logarithm of the longest chain.
    """
    link = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_partkey").alias("old"))
    now = link.select("id", F.when(F.col("old") < F.col("id"), F.col("old")).otherwise(F.col("id")).alias("origin"), (F.col("old") < F.col("id")).cast("int").alias("hops"))
    return T.chased(now).select("id", "origin", F.col("hops").cast("int").alias("hops"))


@query("""WITH best AS (SELECT l_orderkey AS root, CASE WHEN l_linenumber <= 2 THEN 'g' || l_linenumber ELSE '#' || row_number() OVER () END AS slot, l_quantity AS marks FROM lineitem)
SELECT root, sum(m) AS marks FROM (SELECT root, slot, max(marks) AS m FROM best GROUP BY ALL) GROUP BY root""")
def r13_bottom_up_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of one group count once, by the largest; the rest add up."""
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("root"), F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("g"), F.col("l_linenumber").cast("string"))).alias("or_group"), F.monotonically_increasing_id().alias("unit"), F.col("l_quantity").alias("marks"))
    return T.folded_marks(units)
