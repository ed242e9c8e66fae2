"""All labelled texts to train a model on, and models trained on them in shards.

Every shard is one partition. In a round each shard takes its steps from the same model, row by row of its own texts,
and the results are averaged; rows are dealt out and ordered by their ids, so the same rows give the same model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import broadcast_if_small, held_out, text_of

#: Rows of a shard while there are few shards, and the most shards. Larger tables have larger shards, which are read as a stream.
SHARD_ROWS, SHARDS = 4000, 64
#: Labels that are broadcast to the texts; more are joined by shuffle.
LABELS = 1_000_000
#: Blocks in which the rows of a table of parameters are averaged.
BLOCKS = 8


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, lang, y of every labelled document that is not held out.

    Rows held out (crc32 of the id, modulo 4, is 2) are never taken. Of rows that
    share an id, the least text and the greatest label count. Null ids and labels take no part; a null text is empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), lang.cast("string").alias("lang")).where(~held_out())
    least = texts.join(broadcast_if_small(known, LABELS), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.max("y").alias("y"))
    return least.select("doc_id", "row.text", "row.lang", "y")


def shard_count(rows: int) -> int:
    return max(1, min(SHARDS, rows // SHARD_ROWS))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` in shards by their ``doc_id``, kept on the executors' disks until it is unpersisted."""
    return rows.repartition(shards, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").persist(StorageLevel.DISK_ONLY)


def one_round(shards: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray, np.ndarray, float]], table: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The averages of what ``learn`` gives for each of the ``shards``.

    ``learn`` takes the batches of a shard and gives a table of parameters, the weight of each of its rows there (0: not moved), all other
    parameters, and their weight. Rows that no shard moved stay as in ``table``. What reaches the driver has the size of the model.
    """
    width, kind = table.shape[1], table.dtype
    cuts = np.linspace(0, len(table), BLOCKS + 1).astype(int)
    schema = "block int, part int, at binary, sums binary, weights binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def sent(block: int, part: int, at: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        data = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), sums, weights.astype(np.float64))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *data], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        moved, weights, other, weight = learn(chain([first], batches))
        for b in range(BLOCKS):
            at = cuts[b] + np.flatnonzero(weights[cuts[b] : cuts[b + 1]])
            if len(at):
                yield sent(b, part, at, (moved[at] * weights[at, None]).astype(kind), weights[at])
        yield sent(BLOCKS, part, np.zeros(1), other * weight, np.array([weight]))

    def add(of_block: pa.Table) -> pa.Table:  # as many rows as there are shards
        block = of_block.column("block")[0].as_py()
        size, wide, sort = (1, len(flat), np.float64) if block == BLOCKS else (len(table), width, kind)
        sums, weights = np.zeros((size, wide)), np.zeros(size)
        for r in of_block.sort_by("part").to_pylist():
            at = np.frombuffer(r["at"], np.int32)
            sums[at] += np.frombuffer(r["sums"], sort).reshape(len(at), wide)
            weights[at] += np.frombuffer(r["weights"], np.float64)
        at = np.flatnonzero(weights)
        return pa.Table.from_batches([sent(block, 0, at, sums[at] / weights[at, None], weights[at])])

    table, flat = table.copy(), flat.copy()
    for r in shards.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect():
        at, found = np.frombuffer(r["at"], np.int32), np.frombuffer(r["sums"], np.float64)
        if r["block"] == BLOCKS:
            flat = found.copy()
        else:
            table[at] = found.reshape(len(at), width)
    shards.sparkSession.sparkContext._jvm.System.gc()  # the shuffle files of the round are garbage
    return table, flat
