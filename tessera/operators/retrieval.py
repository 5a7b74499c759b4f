"""Candidate retrieval: the best documents by weighted shared elements, found by their rare elements first.

Elements of an item are taken in order of how many documents hold them.  A first, short prefix of that order names some
documents, whose exact scores give each item a score to beat.  A document that shares nothing but the elements behind a
prefix scores at most the sum of their weights, so the prefix only grows until that sum is below the score to beat:
frequent elements make no pairs unless no rarer ones decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import top_per_key
from tessera.sources.stored import written

#: Documents that the first prefix names for each of the k wanted.
PROBE = 4


def weight(element):
    """A phrase (elements with a blank) counts ten, a token one."""
    return F.when(element.contains(" "), 10).otherwise(1)


def candidates(items: DataFrame, docs: DataFrame, k: int, item_id: str, doc_id: str) -> DataFrame:
    """item_id, doc_id, phrases, overlap, score and place of each item's k best; equal scores go by doc_id.

    Both sides have their id and ``elements``, an array of distinct strings.  Items or documents without elements have
    no pairs; ids are unique.
    """
    wanted = items.select(item_id, F.explode("elements").alias("element"))
    # what no item asks for can't score: documents are read whole once, and cut to elements that some item has
    held = docs.select(doc_id, F.explode_outer("elements").alias("element")).join(wanted.select("element").distinct(), "element", "left_semi")
    docs = written(held.groupBy(doc_id).agg(F.collect_list("element").alias("elements")))
    held = docs.select(doc_id, F.explode("elements").alias("element"))
    df = held.groupBy("element").agg(F.count("*").alias("df"))
    order = Window.partitionBy(item_id).orderBy("df", "element")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = wanted.join(df, "element").select(item_id, "element", F.coalesce(F.sum("df").over(upto), F.lit(0)).alias("before"), F.sum(weight(F.col("element"))).over(after).alias("bound"))

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scored(prefix: DataFrame) -> DataFrame:
        # pairs are few bytes but much work, so their partitions aren't left to be merged by size
        pairs = prefix.select(item_id, "element").join(held, "element").select(item_id, doc_id).repartition(tasks, doc_id).distinct()
        full = pairs.join(items.select(item_id, F.col("elements").alias("asked")), item_id).join(docs.select(doc_id, "elements"), doc_id)
        shared = full.select(item_id, doc_id, F.array_intersect("asked", "elements").alias("shared"))
        phrases = F.size(F.filter("shared", lambda e: e.contains(" ")))
        return shared.select(item_id, doc_id, phrases.cast("long").alias("phrases"), (F.size("shared") - phrases).cast("long").alias("overlap")).withColumn("score", 10 * F.col("phrases") + F.col("overlap"))

    by = [F.desc("score"), F.asc(doc_id)]
    probed = top_per_key(scored(ranked.where(F.col("before") < PROBE * k)), [item_id], by, k)
    beat = probed.groupBy(item_id).agg(F.min("score").alias("least"), F.count("*").alias("n")).select(item_id, F.when(F.col("n") < k, 1).otherwise(F.col("least")).alias("least"))
    prefix = ranked.join(beat, item_id).where(F.col("bound") >= F.col("least"))
    return top_per_key(scored(prefix), [item_id], by, k)
