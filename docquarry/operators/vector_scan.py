"""Many queries against a scan of vectors: one matrix product for each batch of rows and block of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.filtering import OWN_FILTERS, facts

#: Bytes of query vectors that one pass over the rows holds; a larger set of queries takes several passes.
BLOCK_BYTES = 32_000_000
#: Scores that are held at a time.
SCORES = 4_000_000
#: Digits to which scores are equal, unless a search asks for the order of the scores as they are. Nearness by matrix product, which
#: differs in the last bits from batch to batch, only chooses the candidates; what is as near as MARGIN is scored term by term.
DIGITS, MARGIN = 12, 1e-9


@dataclass
class QueryBlock:
    """Queries of at most BLOCK_BYTES: by length their places and unit vectors, and the vectors as given; their own filters; the lists that each probes."""

    ids: pa.Array
    units: dict[int, tuple[np.ndarray, np.ndarray]]
    vectors: dict[int, np.ndarray]
    wanted: list[dict | None] | None = None
    probes: dict[tuple[int, int], np.ndarray] | None = None


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components row after row, where each row begins, and its length; rows that are null or hold a null have length 0."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    bad = ~np.isfinite(values)
    if bad.any():
        held = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.where(np.bincount(held, bad, len(lengths)) > 0, 0, lengths)
    return values, starts, lengths


def _rows(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return values[starts[rows][:, None] + np.arange(size)]


def _cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines with every sum taken in the order of the components, as ``functions.vectors.cosine`` takes it: the same vectors have the same score anywhere."""
    in_order = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    length = np.sqrt(in_order(rows * rows)) * np.sqrt(in_order(query * query))
    return np.where(length > 0, in_order(rows * query) / np.where(length > 0, length, 1), 0.0)


def _units(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows as vectors of length 1; those of length 0 stay zero."""
    found = _rows(values, starts, rows, size)
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def query_block(asked: pa.Table) -> QueryBlock:
    column = asked.column("q").combine_chunks()
    values, starts, lengths = _vectors(column)
    units = {int(d): (at := np.flatnonzero(lengths == d), _units(values, starts, at, int(d))) for d in np.unique(lengths) if d}
    given = {d: _rows(values, starts, at, d) for d, (at, _) in units.items()}
    return QueryBlock(asked.column("query_id").combine_chunks(), units, given, asked.column("wanted").to_pylist() if "wanted" in asked.column_names else None)


def _meets(batch: pa.RecordBatch, wanted: dict | None, held: list[str]) -> np.ndarray:
    """Which rows meet a query's own filters; a null filter asks nothing, and a null value meets none."""
    out = np.ones(len(batch), bool)
    for column, name, how in OWN_FILTERS:
        value = (wanted or {}).get(name)
        if column not in held or value is None:
            continue
        has = batch.column(f"own_{column}")
        if how == "in":
            test = pc.is_in(has, pa.array(value, has.type))
        else:
            test = {"is": pc.equal, "from": pc.greater_equal, "to": pc.less_equal}[how](has, pa.scalar(value, has.type))
        out &= pc.fill_null(test, False).to_numpy(zero_copy_only=False) & pc.is_valid(has).to_numpy(zero_copy_only=False)
    return out


def _near(scores: np.ndarray, k: int) -> np.ndarray:
    """The rows with the k largest scores, and those within MARGIN of the least of them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - MARGIN)


def _scan(rows: DataFrame, block: QueryBlock, k: int, tie: str, held: list[str], digits: int | None) -> DataFrame:
    """``query_id, <tie>, score``: the k best of each batch of ``rows`` (tie, v, own_*; list if queries probe lists)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # of bounded size
    kinds = dict(rows.dtypes)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            values, starts, lengths = _vectors(batch.column("v"))
            ids = batch.column(tie)
            place = np.empty(len(batch), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(batch))
            lists = batch.column("list").to_numpy() if asked.probes is not None else np.zeros(len(batch), np.int64)
            masks = {i: _meets(batch, w, held) for i, w in enumerate(asked.wanted)} if asked.wanted is not None and held else None
            for size, (queries, units) in asked.units.items():
                for number in np.unique(lists[lengths == size]):
                    at = np.flatnonzero((lengths == size) & (lists == number))
                    some = np.arange(len(queries)) if asked.probes is None else asked.probes.get((size, int(number)), np.zeros(0, np.int64))
                    vectors = _units(values, starts, at, size) if len(some) else None
                    given = _rows(values, starts, at, size) if len(some) else None
                    step = max(1, SCORES // max(1, len(at)))
                    for low in range(0, len(some), step):
                        part = some[low : low + step]
                        scores = vectors @ units[part].T
                        asked_at, row_at, score_at = [], [], []
                        for column, i in enumerate(part):
                            fits = np.flatnonzero(masks[int(queries[i])][at]) if masks is not None else np.arange(len(at))
                            top = fits[_near(scores[fits, column], k)]
                            exact = _cosines(given[top], asked.vectors[size][i])
                            exact = exact if digits is None else np.round(exact, digits)
                            best = np.lexsort((place[at[top]], -exact))[:k]
                            asked_at.append(np.full(len(best), queries[i]))
                            row_at.append(at[top[best]])
                            score_at.append(exact[best])
                        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(np.concatenate(asked_at))), ids.take(pa.array(np.concatenate(row_at))), pa.array(np.concatenate(score_at))], names=["query_id", tie, "score"])

    return rows.mapInArrow(best, f"query_id {kinds['_query_id']}, `{tie}` {kinds[tie]}, score double")


def blocks_of(queries: DataFrame, block_bytes: int | None = None) -> list[QueryBlock]:
    """Queries (query_id, query, wanted if any) in blocks whose vectors take at most about ``block_bytes``."""
    own = ["wanted"] if "wanted" in queries.columns else []
    asked = queries.where(F.col("query").isNotNull()).select("query_id", F.col("query").cast("array<double>").alias("q"), *own)
    held = asked.agg(F.sum(F.size("q") * 8).alias("bytes")).first()["bytes"] or 0
    n = max(1, -(-held // (block_bytes or BLOCK_BYTES)))
    return [query_block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow()) for b in range(n)]


def best_of(rows: DataFrame, blocks: list[QueryBlock], queries: DataFrame, k: int, tie: str, columns: list[str], digits: int | None = DIGITS) -> DataFrame:
    """``query_id, rank, <tie>, score`` over all blocks. ``rows``: tie, v, list if probed, and the ``columns`` that own filters test."""
    held = facts(columns)
    kind = queries.schema["query_id"].dataType
    # a column that only carries the type of query ids into the scan's schema
    rows = rows.select(tie, "v", *(["list"] if "list" in rows.columns else []), *[F.col(c).alias(f"own_{c}") for c in held], F.lit(None).cast(kind).alias("_query_id"))
    found = reduce(DataFrame.unionByName, [_scan(rows, b, k, tie, held, digits) for b in blocks])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", tie, "score")


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "vec_id", block_bytes: int | None = None, digits: int | None = DIGITS) -> DataFrame:
    """``query_id, rank, <tie>, score``: the k best of each query (query_id, query) by cosine, over all rows.

    A stated set of queries goes against all rows in blocks of bounded size: a block is one matrix product with
    each batch of rows, and only the k best of a batch reach the shuffle. If queries have own filters
    (``wanted``), rows that fail them take no part. Scores equal to ``digits`` tie, to the lesser ``tie``; with None they count as they are. Vectors of another
    length, null ones and those with null or infinite components take no part; a vector of zeros scores 0.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select("*", F.col(vector).alias("v"))
    return best_of(rows, blocks_of(queries, block_bytes), queries, k, tie, vectors.columns, digits)
