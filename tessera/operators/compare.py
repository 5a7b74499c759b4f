"""Comparing sets, rankings and row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, TimestampType

from tessera.operators.windows import average_rank


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays' sets to 4 places; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.bround(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)), 4))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: correlation of average ranks; 1 for one pair or less, and for two constant columns."""
    ranked = pairs.withColumn("__rx", average_rank(keys, F.desc(x), [x])).withColumn("__ry", average_rank(keys, F.desc(y), [y]))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("__rx", "__ry").alias("__c"), F.var_pop("__rx").alias("__vx"), F.var_pop("__ry").alias("__vy"))
    flat = (F.col("__vx") == 0) | (F.col("__vy") == 0)
    rho = F.when(F.col("n") <= 1, 1.0).when((F.col("__vx") == 0) & (F.col("__vy") == 0), 1.0).when(flat, 0.0).otherwise(F.bround(F.col("__c") / F.sqrt(F.greatest(F.col("__vx") * F.col("__vy"), F.lit(1e-300))), 4))
    return sums.select(*keys, "n", rho.alias("rho"))


def row_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: unchanged, changed, new or missing (null-safe on the value)."""
    both = old.select(key, F.col(value).alias("__old"), F.lit(True).alias("__in_old")).join(new.select(key, F.col(value).alias("__new"), F.lit(True).alias("__in_new")), key, "full_outer")
    change = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "missing").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def field_text(rows: DataFrame, column: str) -> Column:
    """A column as text that tells its values apart in any session: instants in microseconds, nested values as JSON, map entries in order."""
    kind, value = rows.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, MapType):
        return F.to_json(F.array_sort(F.map_entries(value)))
    return F.to_json(value) if isinstance(kind, (ArrayType, StructType)) else value.cast("string")


def row_md5(rows: DataFrame, columns: list[str]) -> Column:
    """MD5 of some fields, each with its length in bytes before it, a null with none."""
    texts = [field_text(rows, c) for c in columns]
    return F.md5(F.concat(F.lit(""), *(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def multiset_digest(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) n, digest: order-insensitive digest of whole rows, as exact sums of two halves of their MD5.

    A sum of hashes combines in map-side partial aggregates, where a sorted list of all rows would not.  Every field has
    its length in bytes before it, a null none, so that different rows never read the same.
    """
    row = row_md5(rows, [c for c in rows.columns if c not in (keys or [])])
    part = lambda a: F.conv(F.substring(row, a, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.count("*").alias("n"), F.sum(part(1)).alias("__a"), F.sum(part(9)).alias("__b")]
    out = (rows.groupBy(*keys) if keys else rows).agg(*sums)
    return out.select(*(keys or []), "n", F.concat_ws("-", F.coalesce("__a", F.lit(0)).cast("string"), F.coalesce("__b", F.lit(0)).cast("string")).alias("digest"))


def schema_diff(old: DataFrame, new: DataFrame) -> list[tuple[str, str]]:
    """(column, missing | unexpected | changed) between two frames' schemas."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return sorted([(c, "missing") for c in a.keys() - b.keys()] + [(c, "unexpected") for c in b.keys() - a.keys()] + [(c, "changed") for c in a.keys() & b.keys() if a[c] != b[c]])


def equal_multisets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def exact_cover(seen: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: empty if ``seen`` covers ``expected`` exactly."""
    left = seen.select(key, F.lit(1).alias("__a")).distinct()
    right = expected.select(key, F.lit(1).alias("__b")).distinct()
    both = left.join(right, key, "full_outer").where("__a is null or __b is null")
    return both.select(key, F.when(F.col("__a").isNull(), "missing").otherwise("unexpected").alias("side"))


def running_cap(rows: DataFrame, key: str, order: list, cost: str, cap: float) -> DataFrame:
    """Rows with the cost spent so far within ``key`` and whether the cap is reached."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("capped", spent >= cap)
