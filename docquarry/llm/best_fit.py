"""Best-fit decreasing packing of token pieces into sequences.

Lengths are whole numbers up to the capacity, so best-fit decreasing depends on
the counts of each length alone. The counts (at most ``capacity`` rows,
however large the corpus) go to the driver, which runs best-fit decreasing
on them: a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and equal documents that meet equal bins are placed
together. The result is what the document-by-document algorithm gives. Each
piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import narrow, staged
from docquarry.llm.token_ids import default_path, encoder


class CapacityTree:
    """Which remaining capacities have open bins; finds the least one of at least x."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.full = np.zeros(2 * self.size, bool)

    def mark(self, value: int, on: bool) -> None:
        i = value + self.size
        self.full[i] = on
        while i > 1:
            i //= 2
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.full[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs of placements and the number of bins.

    A run (length, first rank, pieces, first bin, pieces per bin, offset): the
    pieces of that length and those ranks fill consecutive bins from the
    offset on.
    """
    tree = CapacityTree(capacity)
    opened: dict[int, deque[tuple[int, int]]] = {}
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            opened.setdefault(room, deque()).append((first, n))
            tree.mark(room, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = opened[room].popleft()
                if not opened[room]:
                    del opened[room]
                    tree.mark(room, False)
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, whole * each, first, each, capacity - room))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and 0 < left:  # the rest is less than one bin's share
                runs.append((length, rank, left, first + whole, each, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, n - whole) if room < capacity else None
    return runs, bins


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """The pieces of each document: its ids and ``end_id``, cut only beyond the capacity."""
    path = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        step = 4 * capacity
        for frame in frames:
            ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            rows: list[tuple] = []
            for at in range(0, len(texts), 64):
                some = texts[at : at + 64]
                for doc, by_word in zip(ids[at : at + 64], enc.ids_by_word(some), strict=True):
                    whole = b"".join(by_word) + end
                    rows += [(doc, k // step, k // 4, min(step, len(whole) - k) // 4, zlib.crc32(whole[k : k + step])) for k in range(0, len(whole), step)]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return narrow(docs).mapInPandas(cut, PIECES)


def pack_best_fit(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 200_000) -> DataFrame:
    """``pieces`` (of token_pieces) with ``sequence_id`` and ``offset``.

    The rank of a piece among those of its length is the number of pieces in
    lower salts plus its row number within its own salt, so a length that
    holds most rows is spread over many tasks. Repeated rows are packed as
    often as they occur; an empty table gives an empty table.
    """
    pieces = staged(pieces, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit_plan(counts, capacity)
    total = sum(counts.values())
    salts = max(8, -(-total // rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "salt", "before")
    # at most capacity x salts rows of 24 bytes, a ten-thousandth of the pieces at large sizes; Spark picks the join
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("rank"))
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame.pop("rank").to_numpy(np.int64)
            run = table[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1] if len(frame) else table[:0]
            nth = rank - run[:, 1]
            frame["sequence_id"] = run[:, 3] + nth // np.maximum(run[:, 4], 1)
            frame["offset"] = run[:, 5] + nth % np.maximum(run[:, 4], 1) * length
            yield frame

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
