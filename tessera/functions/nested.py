"""Array, struct and JSON expressions: quantifiers, blockers, clamped indexing, share splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(json: Column, where: str, kind: str = "string") -> Column:
    return F.get_json_object(json, f"$.{where}").cast(kind)


def json_kind(json: Column, where: str) -> Column:
    """absent, null, boolean, number, string, array or object of a JSON field."""
    kind = F.schema_of_variant(F.try_variant_get(F.parse_json(json), f"$.{where}", "variant"))
    return (
        F.when(kind.isNull(), "absent").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def blockers(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order, distinct."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, name) for name, c in rules))))


def clamped(values: list, at: Column) -> Column:
    """values[min(at, last)], from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (F.least(at, F.lit(len(values) - 1)) + 1).cast("int"))


def split_shares(primary: Column, secondary: Column) -> Column:
    """Array of (node, role, share): primary weighs 1, each secondary one half, normalised to 1."""
    total = 1.0 + 0.5 * F.size(secondary)
    first = F.array(F.struct(primary.alias("node"), F.lit("primary").alias("role"), (1.0 / total).alias("share")))
    rest = F.transform(secondary, lambda n: F.struct(n.alias("node"), F.lit("secondary").alias("role"), (0.5 / total).alias("share")))
    return F.concat(first, rest)


def all_ready(states: Column) -> Column:
    """Every dimension passed or doesn't apply."""
    return F.forall(states, lambda s: s.isin("passed", "not_applicable"))
