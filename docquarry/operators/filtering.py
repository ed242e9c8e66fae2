"""Filters of a search: those of a request and those that a question brings itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.containment import json_contains, variant_contains

#: Metadata keys that may be filtered on.
META_KEYS = ("user_id", "user_name", "project", "report_date", "document_title", "section", "page_number")


def filters(where: dict, vector_leg: bool = True, metadata: str = "map") -> Column:
    """One predicate from a filter map; unknown metadata keys are an error.

    Keys: document_ids, user_ids, date_from, date_to (of created_at), project,
    report_date_from, report_date_to, model_name (vector leg only), meta. ``metadata`` says what the column of that
    name is: a "map" of strings, "json" text or a "variant"; in the last two, values are held by kind and may be nested.
    """
    parts = [F.col("deleted_at").isNull()] if where.get("live_only") else []
    for key, column in (("document_ids", "doc_id"), ("user_ids", "user_id")):
        if where.get(key):
            parts.append(F.col(column).isin(list(where[key])))
    for key, column, op in (("date_from", "created_at", "ge"), ("date_to", "created_at", "le"), ("report_date_from", "report_date", "ge"), ("report_date_to", "report_date", "le")):
        if where.get(key) is not None:
            value = F.lit(where[key])
            parts.append(F.col(column) >= value if op == "ge" else F.col(column) <= value)
    for key in ("project", *(("model_name",) if vector_leg else ())):
        if where.get(key) is not None:
            parts.append(F.col(key) == where[key])
    for key, value in (where.get("meta") or {}).items():
        if key not in META_KEYS:
            raise ValueError(f"{key} is not a metadata key")
        if metadata == "map":
            parts.append(F.col("metadata")[key] == str(value))
        else:
            parts.append((json_contains if metadata == "json" else variant_contains)(F.col("metadata"), {key: value}))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def merge_filters(extracted: dict, requested: dict, owner: str | int | None = None) -> dict:
    """What was asked for overrides what was read from the question; the owner overrides both."""
    merged = {**extracted, **{k: v for k, v in requested.items() if k in ("document_ids", "date_from", "date_to", "meta")}}
    return merged if owner is None else {**merged, "user_ids": [owner]}


#: What a question's own filters test: column of a chunk, filter, and how.
OWN_FILTERS = (("user_name", "user_names", "in"), ("project", "project", "is"), ("report_date", "date_from", "from"), ("report_date", "date_to", "to"), ("doc_id", "doc_ids", "in"))


def passes(wanted: str, row: str, held: list[str]) -> Column:
    """Whether a chunk (a struct with the columns ``held``) meets a question's own filters (a struct); a null filter asks nothing."""
    tests = []
    for column, name, how in OWN_FILTERS:
        if column in held:
            asked, has = F.col(f"{wanted}.{name}"), F.col(f"{row}.{column}")
            test = {"in": F.array_contains(asked, has), "is": has == asked, "from": has >= asked, "to": has <= asked}[how]
            tests.append(asked.isNull() | F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def facts(columns: list[str]) -> list[str]:
    """The columns of a chunk that a question's own filters test."""
    return [c for c in dict.fromkeys(column for column, _, _ in OWN_FILTERS) if c in columns]
