"""Type gates over semi-structured values: a value of the wrong type is null, never cast into another one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import stripped


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, DECIMAL(..), DOUBLE, ARRAY<..> or OBJECT<..>; null where there is no value."""
    return F.schema_of_variant(value)


def part(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def string(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def integer(value: Column) -> Column:
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def number(value: Column) -> Column:
    """Whole or broken numbers as double; a boolean is none."""
    return F.when(kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def boolean(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def is_object(value: Column) -> Column:
    return kind(value).startswith("OBJECT")


def objects(value: Column) -> Column:
    """The objects of an array, or a single object as an array of one; everything else is skipped."""
    many = F.filter(F.try_variant_get(value, "$", "array<variant>"), is_object)
    none = F.array().cast("array<variant>")
    return F.when(kind(value).startswith("ARRAY"), F.coalesce(many, none)).when(is_object(value), F.array(value)).otherwise(none)


def coerced_id(value: Column) -> Column:
    """A whole number, or a string of digits with a sign and white space around; a boolean, a broken number and all else give null."""
    text = stripped(string(value))
    return F.coalesce(integer(value), F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint")))
