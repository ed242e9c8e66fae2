"""Word shingles: the shared definition.

Words are the runs of letters and digits of the text in lower case; a shingle
is five words in a row. Texts of fewer than five words have no shingles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5


def clean_text(text: Column) -> Column:
    """The words of the text, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_list(text: Column) -> Column:
    return F.split(clean_text(text), " ")


def shingle_places(words: Column) -> Column:
    """1, 2, ... up to the last word that starts a shingle."""
    n = F.size(words) - (WORDS - 1)
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WORDS)))


def shingle_texts(words: Column, places: Column) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, WORDS), " ")))
