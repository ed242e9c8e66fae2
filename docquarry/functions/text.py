"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_markdown(text: Column) -> Column:
    """Images go, links keep their label, heading marks and emphasis marks go."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    return F.regexp_replace(F.regexp_replace(out, r"[*_~`]", ""), r"^\s+|\s+$", "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def terms(text: Column) -> Column:
    """Lower-case ASCII terms of a text, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def like_pattern(needle: str) -> str:
    """A LIKE pattern that finds ``needle`` anywhere, with its wildcards taken literally."""
    return "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; null for anything else."""
    return F.from_json(text, "map<string,string>")
