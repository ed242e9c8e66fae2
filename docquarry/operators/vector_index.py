"""An inverted-file index of vectors: written by list, read only where queries probe.

Lists are k-means centroids of unit vectors, fitted on a bounded sample; every row is written to the list of its
nearest centroid, partitioned by vector length and list. A search finds the lists nearest to each query, and the
scan reads no other partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.vectors import norm
from docquarry.operators.vector_scan import DIGITS, _units, _vectors, best_of, blocks_of

#: Rows that centroids are fitted on, for each vector length.
SAMPLE = 50_000
#: Of these, the rows and the queries that the number of probes is fitted on.
TUNED, TUNED_QUERIES = 5_000, 200
#: Most lists of one vector length.
MOST_LISTS = 4_096
#: Rows of a list that one task writes.
ROWS_PER_FILE = 500_000


def _centroids(rows: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors (column ``v``), ``lists`` at most."""
    if lists < 2:
        return np.array([r["v"] for r in rows.limit(1).collect()])
    model = KMeans(k=lists, featuresCol="features", distanceMeasure="cosine", maxIter=15, seed=seed).fit(rows.select(array_to_vector("v").alias("features")))
    found = np.array(model.clusterCenters())
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` lists whose centroids have the largest inner products with each vector, the nearest first."""
    scores = vectors @ centroids.T
    probes = min(probes, scores.shape[1])
    some = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(scores, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _probes_for(rows: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10) -> int:
    """The least number of probes at which the first TUNED_QUERIES of ``rows`` find ``recall`` of their k nearest among ``rows``.

    Neighbours in a sample are further away than in all rows, so this is rather too many.
    """
    asked = rows[:TUNED_QUERIES]
    near = nearest_lists(asked @ rows.T, np.eye(len(rows)), k + 1)  # the k + 1 largest inner products: itself is one
    own = nearest_lists(rows, centroids, 1)[:, 0]
    order = nearest_lists(asked, centroids, len(centroids))
    if len(rows) < 2:
        return 1
    depth = np.sort([int(np.flatnonzero(order[q] == own[r])[0]) for q in range(len(asked)) for r in near[q] if r != q])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def build_index(vectors: DataFrame, path: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 7, recall: float = 0.95) -> VectorIndex:
    """Writes ``vectors`` by vector length and list below ``path``.

    A search probes as many lists as reach ``recall`` on a sample, unless it names a number. The number of lists grows with the root of the rows of a length (``lists`` sets it). Vectors that are null, zero or hold null or infinite
    components are not in the index. Repeated rows are all in it, and a list that holds very many is written by several tasks.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    good = vectors.where(F.col(vector).isNotNull() & finite).where(norm(F.col(vector)) > 0)
    sizes = {int(r["d"]): int(r["n"]) for r in good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    centroids: dict[int, np.ndarray] = {}
    probes: dict[int, int] = {}
    for size, n in sorted(sizes.items()):
        own = good.where(F.size(vector) == size)
        unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.col("length"))
        # the rows of least hash: the same sample for the same rows
        some = own.withColumn("length", norm(F.col(vector))).select(unit.alias("v"), F.xxhash64(vector).alias("h")).orderBy("h").limit(sample).cache()
        centroids[size] = _centroids(some, max(1, min(lists or int(n**0.5), MOST_LISTS, n)), seed)
        tuned = np.array([r["v"] for r in some.limit(TUNED).collect()])
        probes[size] = _probes_for(tuned, centroids[size], recall)
        some.unpersist()
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS vectors of each length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, lengths = _vectors(batch.column(vector))
            found = np.zeros(len(batch), np.int32)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                for low in range(0, len(at), 2000):
                    found[at[low : low + 2000]] = nearest_lists(_units(values, starts, at[low : low + 2000], int(size)), shared.value[int(size)], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(found)], names=[*batch.schema.names, "dimensions", "list"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in good.dtypes)
    listed = good.mapInArrow(assign, f"{kinds}, dimensions int, list int")
    shares = max(1, -(-sum(sizes.values()) // ROWS_PER_FILE))  # if all rows were in one list
    dealt = listed.repartition("dimensions", "list", F.pmod(F.xxhash64(*[c for c, k in good.dtypes if not k.startswith("map")]), F.lit(shares)))
    dealt.write.mode("overwrite").partitionBy("dimensions", "list").parquet(f"{path}/rows")
    flat = [(d, k, c.tolist(), probes[d]) for d, cs in centroids.items() for k, c in enumerate(cs)]
    spark.createDataFrame(flat, "dimensions int, list int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
    return VectorIndex(spark, path, vector)


@dataclass
class VectorIndex:
    """A written index; ``search`` reads only the lists that queries probe."""

    spark: SparkSession
    path: str
    vector: str = "embedding"
    _centroids: dict[int, np.ndarray] = field(default_factory=dict)
    probes: dict[int, int] = field(default_factory=dict)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def centroids(self) -> dict[int, np.ndarray]:
        if not self._centroids:
            found: dict[int, list] = {}
            for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("dimensions", "list").collect():  # MOST_LISTS rows of each length
                found.setdefault(r["dimensions"], []).append(r["centroid"])
                self.probes[r["dimensions"]] = r["probes"]
            self._centroids = {d: np.array(cs) for d, cs in found.items()}
        return self._centroids

    def search(self, queries: DataFrame, k: int, probes: int | None = None, tie: str = "vec_id", where: Column | None = None, digits: int | None = DIGITS) -> DataFrame:
        """``query_id, rank, <tie>, score``: the k best of each query (query_id, query, own filters ``wanted``) in the ``probes`` lists nearest to it (by default, what the index was fitted to).

        Scores are exact cosines, which tie if equal to ``digits`` (None: as they are). A query with no list of its length finds nothing.
        """
        blocks = blocks_of(queries)
        asked: set[tuple[int, int]] = set()
        for block in blocks:
            block.probes = {}
            for size, (_, units) in block.units.items():
                if size in self.centroids():
                    lists = nearest_lists(units, self.centroids()[size], probes or self.probes[size])
                    for number in np.unique(lists):
                        block.probes[(size, int(number))] = np.flatnonzero((lists == number).any(axis=1))
            asked |= block.probes.keys()
        rows = self.rows
        read = F.lit(False)
        for size in sorted({d for d, _ in asked}):
            read = read | ((F.col("dimensions") == size) & F.col("list").isin([n for d, n in sorted(asked) if d == size]))
        rows = rows.where(read)
        rows = rows if where is None else rows.where(where)
        return best_of(rows.withColumn("v", F.col(self.vector)), blocks, queries, k, tie, rows.columns, digits)
