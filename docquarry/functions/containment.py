"""Whether a JSON value holds another, by kind: objects within objects, elements within arrays, numbers apart from strings."""

from __future__ import annotations

from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def _member(held: Column, name: str) -> Column:
    """The value of a key of an object, null if it is not there."""
    mark = next((m for m in "'\"" if m not in name), None)
    if mark is None:
        return F.try_element_at(F.try_variant_get(held, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(held, f"$[{mark}{name}{mark}]", "variant")


def variant_contains(held: Column, value: object) -> Column:
    """Whether the variant ``held`` holds ``value`` (dict, list, string, number, bool or None).

    Every key of an object must be there and hold its value, every element of a list must be held by some element of an array, in any order; a
    single value is also held by an array that has it. Numbers are equal by value, and never to strings. A null variant holds nothing.
    """
    kind = F.schema_of_variant(held)
    no = F.lit(False)
    if isinstance(value, dict):
        parts = [F.coalesce(variant_contains(_member(held, str(k)), v), no) for k, v in value.items()]
        return F.coalesce(reduce(lambda a, b: a & b, parts, kind.startswith("OBJECT")), no)
    items = F.try_variant_get(held, "$", "array<variant>")
    if isinstance(value, list):
        parts = [F.coalesce(F.exists(items, partial(_within, v)), no) for v in value]
        return F.coalesce(reduce(lambda a, b: a & b, parts, kind.startswith("ARRAY")), no)
    return F.coalesce(_same(held, value), no) | F.coalesce(F.exists(items, lambda x: F.coalesce(_same(x, value), no)), no)


def _within(value: object, held: Column) -> Column:
    """An element of a list: single values must be equal, others held."""
    return variant_contains(held, value) if isinstance(value, (dict, list)) else F.coalesce(_same(held, value), F.lit(False))


def _same(held: Column, value: object) -> Column:
    kind = F.schema_of_variant(held)
    if value is None:
        return F.is_variant_null(held)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(held, "$", "boolean") == value)
    if isinstance(value, (int, float, Decimal)):
        return kind.rlike(_NUMBER) & (F.try_variant_get(held, "$", "double") == float(value))
    return (kind == "STRING") & (F.try_variant_get(held, "$", "string") == str(value))


def json_contains(text: Column, value: object) -> Column:
    """The same for JSON text; what is no JSON holds nothing."""
    return variant_contains(F.try_parse_json(text), value)
