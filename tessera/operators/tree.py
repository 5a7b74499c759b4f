"""Trees as edge tables (id, parent_id): closures, ancestors, leaves, inheritance, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.stored import written


class CycleError(ValueError):
    """A node is its own ancestor."""


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, id, depth): every node with itself (depth 0) and all its ancestors.

    Depths double from round to round, so rounds follow the logarithm of the tree's depth, each a join with a table of
    topics.  From the second on they are written, so that plans don't grow with depth.  A node that comes back to itself
    raises CycleError.  A missing parent ends the chain.
    """
    own = nodes.select("id").distinct()
    now = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth")).join(own.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", "depth")
    reach = 1
    while True:
        last = now.where(F.col("depth") == reach).select("id", "ancestor")
        if not now.where("id = ancestor").isEmpty():
            raise CycleError("a node is its own ancestor")
        if last.isEmpty():
            break
        ahead = now.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        now = now.unionByName(last.join(ahead, "ancestor").select("id", F.col("further").alias("ancestor"), (F.col("more") + reach).alias("depth")))
        if reach > 1:
            now = written(now)
        reach *= 2
    return own.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth")).union(now.select("ancestor", "id", "depth"))


def preorder_keys(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, k): (seq, id) of every ancestor from the root down, which order as a depth-first walk by (seq, id) does."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("seq"), F.col("ancestor"))))
    keyed = closed.join(nodes.select(F.col("id").alias("ancestor"), "seq"), "ancestor").groupBy("id").agg(steps.alias("steps"))
    return keyed.select("id", F.transform("steps", lambda s: F.struct(s["seq"].alias("seq"), s["ancestor"].alias("id"))).alias("k"))


def chased(pointers: DataFrame, most: int = 40) -> DataFrame:
    """(id, origin, hops): pointers (id, origin, hops; at itself where a chain ends) followed to the end, in doubling steps.

    Stops when no pointer moves; chains of more than 2^most hops, or a cycle, raise CycleError.  Every round is written,
    so that it is one join and no round before it runs again.
    """
    now = written(pointers.select("id", "origin", "hops"))
    for _ in range(most):
        step = now.select(F.col("id").alias("origin"), F.col("origin").alias("next"), F.col("hops").alias("more"))
        further = now.join(step, "origin", "left").select("id", F.coalesce("next", "origin").alias("origin"), F.when(F.col("origin") == F.col("id"), F.lit(0)).otherwise(F.coalesce("more", F.lit(0))).alias("more"), "hops")
        further = written(further)
        if further.where("more > 0").isEmpty():
            return now
        now = further.select("id", "origin", (F.col("hops") + F.col("more")).alias("hops"))
    raise CycleError("a cycle of pointers")


def chains(closed: DataFrame, separator: str = "/") -> DataFrame:
    """(id, path): ids from the root down."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor")))
    return closed.groupBy("id").agg(F.array_join(F.transform(steps, lambda s: s["ancestor"]), separator).alias("path"))


def ancestor_at(closed: DataFrame, nodes: DataFrame, level: str) -> DataFrame:
    """(id, ancestor): each node's nearest ancestor of a level, itself included."""
    at = nodes.where(F.col("level") == level).select(F.col("id").alias("ancestor"))
    return closed.join(at, "ancestor").groupBy("id").agg(F.min_by("ancestor", "depth").alias("ancestor"))


def leaves(nodes: DataFrame, level: str) -> DataFrame:
    """Nodes of a level without children, whatever is excluded later."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id"))
    return nodes.where(F.col("level") == level).join(parents, "id", "left_anti")


def descendant_leaves(closed: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """(ancestor, id) for every leaf below (or at) a node."""
    return closed.join(leaf_rows.select("id"), "id", "left_semi").select("ancestor", "id")


def applicable(closed: DataFrame, nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Active nodes neither excluded nor below an excluded node."""
    barred = closed.join(excluded.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return nodes.where("status = 'active'").join(barred, "id", "left_anti")


def all_supported(closed: DataFrame, supported: DataFrame) -> DataFrame:
    """Ids whose every ancestor, itself included, is in ``supported``."""
    marked = closed.join(supported.select(F.col("id").alias("ancestor"), F.lit(True).alias("yes")), "ancestor", "left")
    return marked.groupBy("id").agg(F.bool_and(F.coalesce("yes", F.lit(False))).alias("ok")).where("ok").select("id")


def folded_marks(units: DataFrame) -> DataFrame:
    """(root, marks): parts summed, alternatives of one or_group counted once by their largest.

    ``units``: root, or_group (null: on its own), unit, marks.
    """
    group = F.coalesce(F.col("or_group"), F.concat(F.lit("#"), F.col("unit").cast("string")))
    best = units.groupBy("root", group.alias("slot")).agg(F.max("marks").alias("marks"))
    return best.groupBy("root").agg(F.sum("marks").alias("marks"))


def positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Ordinal in syllabus order over all rows; for tables of topics, not of facts."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
