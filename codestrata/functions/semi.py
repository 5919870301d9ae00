"""Semi-structured rows: aliases, pointers and vectors in JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """Variant of a JSON text; null where it is malformed."""
    return F.try_parse_json(c)


def pick_str(v: Column, keys: list[str]) -> Column:
    """The first string among the keys (a string, not a number or another kind)."""
    one = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    return F.coalesce(*[one(k) for k in keys])


def pick_vector(v: Column, keys: list[str]) -> Column:
    """The first array among the keys, as floats without what is no number."""
    one = lambda k: F.try_variant_get(v, f"$.{k}", "array<variant>")
    numbers = F.transform(F.coalesce(*[one(k) for k in keys]), lambda x: F.when(~F.schema_of_variant(x).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(x, "$", "float")))
    return F.filter(numbers, lambda x: x.isNotNull())


def pointer(v: Column, path: str, kind: str) -> Column:
    """``/a/b/0`` access."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.strip("/").split("/") if p)
    return F.try_variant_get(v, f"${steps}", kind)


def string_list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def sorted_distinct(a: Column, most: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(a))
    return F.slice(out, 1, most) if most else out


def require_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error where its length differs."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector of length {dim} expected, got "), F.size(v).cast("string"))).cast("array<float>"))


def ordered_extras(c: Column) -> Column:
    """A map of a JSON object's fields in the order of their names, values as JSON text; null where it is no object."""
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"))
    return F.map_from_entries(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))))
