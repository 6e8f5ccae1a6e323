"""Column expressions over JSON text, through Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """'OBJECT', 'ARRAY' or the scalar type name of a variant; null when absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def members(v: Column) -> Column:
    """Members of an object as map<string, variant>; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """Elements of an array as array<variant>; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")
