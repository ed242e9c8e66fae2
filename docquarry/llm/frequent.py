"""The most frequent words of a table of counts, as many as a bound allows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, limit: int, most_bytes: int, least: int = 1) -> tuple[pa.Table, int | None]:
    """The words (of at most ``most_bytes``) that occur ``floor`` times or more, by falling ``n``, and ``floor``.

    ``floor`` is the least border between steps of a 32nd of a power of two that leaves at most ``limit`` of them, so no task sorts
    the words. None: no word fits. Columns are those of ``counts``; words of equal counts are in the order of the other columns.
    """
    short = counts.where((F.col("n") >= least) & (F.octet_length("word") <= most_bytes))
    steps = short.groupBy(F.floor(F.log2("n") * 32).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("floor")).collect()  # some 2000 rows at most
    floor, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["words"]
        if total > limit:
            break
        floor = r["floor"]
    order = [("n", "descending")] + [(c, "ascending") for c in counts.columns if c != "n"]
    found = short.where(F.col("n") >= floor) if floor is not None else short.where(F.lit(False))
    return found.toArrow().sort_by(order), floor
