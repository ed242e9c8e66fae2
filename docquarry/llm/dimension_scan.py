"""Largest-inner-product search by an adaptive dimension scan of inverted lists.

Every vector gets one more component that makes all lengths equal, so that the
largest inner product is the least distance; k-means on a bounded
sample deals all vectors into lists, whose number grows with the root of the table's
rows: each list is a coarse centroid plus one of the centroids of what is left after
it. A query probes its nearest lists. Within a
list the vectors lie rotated by a random orthogonal matrix and stored in blocks
of columns: after each block, a hypothesis test on the partial distance
abandons candidates that are very unlikely to beat the query's bound. Survivors
are scored exactly, on the original vectors in double precision.

The bound of a query comes from a few seed rows in the lists that it probes: its k-th
best score among them. Those k rows are candidates found, like the survivors of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import staged

#: Columns added before each test; from the last on, the rest in steps of it.
BLOCKS = (16, 16, 32, 64, 128)
#: Strength of the test: a larger one abandons less and misses less.
EPSILON = 2.1
#: Share of pairs left from which on a block is computed for all pairs by one matrix product.
DENSE = 0.05
#: Queries compared with a part of a list at once, and queries of a list beyond which the list is read by several tasks.
QUERY_ROWS, LIST_QUERIES = 64, 1_000_000
#: Coarse centroids, and centroids of what is left after them, at most.
COARSE, FINE = 512, 512
#: Rows that give the bounds: at most so many, and at most this share of the table.
SEEDS, SEED_SHARE = 8192, 0.125


@dataclass
class ListModel:
    longest: float  # the largest length of a vector
    coarse: np.ndarray  # [lists, dims + 1]
    fine: np.ndarray  # [lists of each, dims + 1]
    rotation: np.ndarray
    probes: int
    k: int
    seed_ids: np.ndarray
    seeds: np.ndarray
    seed_lists: np.ndarray
    sizes: np.ndarray  # rows of each list

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def near_lists(self, lifted: np.ndarray) -> np.ndarray:
        """Squared distance to each list's centre, up to the same number for a row."""
        one = (self.coarse**2).sum(1)[None] - 2 * lifted @ self.coarse.T
        if len(self.fine) == 1:
            return one
        two = (self.fine**2).sum(1)[None] - 2 * lifted @ self.fine.T
        return (one[:, :, None] + two[:, None, :] + 2 * (self.coarse @ self.fine.T)[None]).reshape(len(lifted), -1)

    def list_of(self, x: np.ndarray) -> np.ndarray:
        lifted, step = self.lift(x), max(1, (1 << 22) // self.lists)
        parts = [self.near_lists(lifted[at : at + step]).argmin(1) for at in range(0, len(lifted), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def scan(columns: np.ndarray, qs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may lie within the queries' squared distances ``bounds``.

    ``columns`` is [dims, rows], rotated, and so are the queries. After each block of
    columns, pairs whose partial distance fails the test are abandoned. While many
    pairs are left a block is added for all of them at once, later for those left.
    """
    dims, n = columns.shape
    partial = np.zeros((len(qs), n))
    q_at = r_at = None
    d, k = 0, 0
    while d < dims:
        size = min(BLOCKS[min(k, len(BLOCKS) - 1)], dims - d)
        block, own = columns[d : d + size], qs[:, d : d + size]
        k, d = k + 1, d + size
        limit = bounds * (d / dims) * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dims else bounds * (1 + 1e-9) + 1e-9
        if q_at is None:
            partial += (own * own).sum(1)[:, None] + (block * block).sum(0)[None] - 2 * (own @ block)
            alive = partial <= limit[:, None]
            if d == dims or alive.mean() < DENSE:
                q_at, r_at = np.nonzero(alive)
                partial = partial[q_at, r_at]
        else:
            gap = block[:, r_at] - own[q_at].T
            partial = partial + np.einsum("dn,dn->n", gap, gap)
            keep = partial <= limit[q_at]
            q_at, r_at, partial = q_at[keep], r_at[keep], partial[keep]
    return q_at, r_at


def pair_scores(qs: np.ndarray, x: np.ndarray, q_at: np.ndarray, r_at: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed component by component: equal rows get equal scores."""
    out = np.zeros(len(q_at))
    for d in range(x.shape[1]):
        out += x[r_at, d] * qs[q_at, d]
    return out


def best_of_each(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: null, zero, empty or non-finite vectors take no part, nor do
    rows without an id; of rows that share an id, the one with the greatest vector stays."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).groupBy("vec_id").agg(F.max("v").alias("v"))


def k_means(rows: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    nearest = lambda: ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
    for _ in range(rounds):
        at = nearest()
        count = np.bincount(at, minlength=n)
        for d in range(rows.shape[1]):
            total = np.bincount(at, weights=rows[:, d], minlength=n)
            centres[:, d] = np.where(count, total / np.maximum(count, 1), centres[:, d])
    return centres


def fit_lists(sample_ids: np.ndarray, sample: np.ndarray, n: int, longest: float, k: int, lists: int | None, target: float, seed: int = 11) -> ListModel:
    """k-means on the sample; probes are set so that ``target`` of the true neighbours
    of sample queries (found by brute force within the sample) lie in probed lists."""
    rng = np.random.default_rng(seed)
    lists = lists or max(1, round(np.sqrt(n) / 2))
    most = max(1, len(sample) // 16)
    coarse = min(lists, most, COARSE)
    fine = min(-(-lists // coarse), most, FINE)
    dims = sample.shape[1] + 1
    seeds = rng.permutation(len(sample))[: max(k + 1, min(SEEDS, int(n * SEED_SHARE)))]
    none = np.zeros((1, dims))
    model = ListModel(longest, none, none, np.linalg.qr(rng.normal(size=(dims, dims)))[0], 1, k, sample_ids[seeds], sample[seeds], none, none)
    lifted = model.lift(sample)
    model.coarse = k_means(lifted, coarse, rng)
    if fine > 1:
        model.fine = k_means(lifted - model.coarse[model.list_of(sample)], fine, rng)
    at = model.list_of(sample)
    model.seed_lists = at[seeds]
    tried = rng.permutation(len(sample))[:200]
    found = sample[tried] @ sample.T
    found[np.arange(len(tried)), tried] = -np.inf
    top = np.argsort(-found, axis=1)[:, : min(k, len(sample) - 1)]
    ranks = []
    for q, near in zip(tried.tolist(), top, strict=True):
        gaps = model.near_lists(np.append(sample[q], 0)[None])[0]
        ranks.append((gaps[None] < gaps[at[near]][:, None]).sum(1))
    model.probes = min(model.lists, int(np.quantile(ranks, target)) + 1) if top.size else model.lists
    return model


HITS = "query_id long, vec_id long, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search_lists(vectors: DataFrame, query_filter, k: int = 20, sample_rows: int = 8192, lists: int | None = None, target: float = 0.97, list_rows: int = 32_768, with_seeds: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``query_filter`` (a Column) picks.

    The model is fitted on at most ``sample_rows`` rows; every row is indexed, those of the sample too. A query
    probes more lists than the model says where those hold too few rows for k results. Of equal
    vectors only the k + 1 smallest ids can be among any k nearest, so a
    vector that many rows share does not swell its list. Lists beyond ``list_rows``
    are split; a part is held once while the queries that probe it stream past, and read
    by several tasks only where LIST_QUERIES of them do. Ties go to the smaller id. Rows whose
    length is not the most frequent one take no part, nor do those that ``valid_vectors`` leaves out. Empty tables give
    empty results. ``with_seeds=False`` leaves out the rows that gave the bound, to measure the scan alone.
    """
    spark = vectors.sparkSession
    found = staged(valid_vectors(vectors), "vectors")
    sizes = found.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n, longest = int(sizes[0]["dims"]), int(sizes[0]["n"]), float(np.sqrt(sizes[0]["longest"])) * (1 + 1e-12)
    found = found.where(F.size("v") == dims)
    nth = Window.partitionBy("v").orderBy("vec_id")
    distinct = found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    rows = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()  # bounded by sample_rows
    model = fit_lists(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"]), n, longest, k, lists, target)
    shared = spark.sparkContext.broadcast(model)  # bounded: SEEDS rows and COARSE + FINE centroids of `dims` numbers

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(list=shared.value.list_of(_matrix(frame["v"])).astype(np.int32))

    dealt = staged(distinct.mapInPandas(assign, "vec_id long, v array<double>, list int"), "lists")
    model.sizes = np.zeros(model.lists, np.int64)
    for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row per list, COARSE * FINE at most
        model.sizes[r["list"]] = r["n"]
    filled = spark.sparkContext.broadcast(model)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Seed hits (list -1), and a row for each list to scan."""
        own = filled.value
        empty = np.where(own.sizes > 0, 0, np.inf)
        step = max(1, min(128, (1 << 22) // own.lists))
        for frame in frames:
            for at in range(0, len(frame), step):
                qs, ids = _matrix(frame["v"].iloc[at : at + step]), frame["vec_id"].to_numpy()[at : at + step]
                gaps = own.near_lists(np.concatenate([qs, np.zeros((len(qs), 1))], 1)) + empty
                order = np.argsort(gaps, axis=1, kind="stable")
                enough = (np.cumsum(own.sizes[order], axis=1) <= k).sum(1) + 1
                probed = np.arange(own.lists)[None] < np.maximum(own.probes, enough)[:, None]
                probed &= np.take_along_axis(np.isfinite(gaps), order, 1)
                chosen = np.zeros_like(probed)
                np.put_along_axis(chosen, order, probed, axis=1)
                score = np.where(chosen[:, own.seed_lists] & (ids[:, None] != own.seed_ids[None]), qs @ own.seeds.T, -np.inf)
                bound = np.full(len(qs), -np.inf)
                if score.shape[1] >= k:
                    cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    q_at, r_at = np.nonzero((score >= cut[:, None] - 1e-9 * (1 + own.longest**2)) & np.isfinite(score) & np.isfinite(cut)[:, None])
                    exact = pair_scores(qs, own.seeds, q_at, r_at)
                    top = best_of_each(q_at, exact, own.seed_ids[r_at], k)
                    bound[np.isfinite(cut)] = np.inf
                    np.minimum.at(bound, q_at[top], exact[top])
                    yield pd.DataFrame({"query_id": ids[q_at[top]], "list": -1, "q": None, "bound": None, "vec_id": own.seed_ids[r_at[top]], "score": exact[top]})
                q_at, list_at = np.nonzero(chosen)
                yield pd.DataFrame({"query_id": ids[q_at], "list": list_at.astype(np.int32), "q": [qs[i] for i in q_at], "bound": bound[q_at], "vec_id": pd.array([None] * len(q_at), "Int64"), "score": None})

    queries = found.where(query_filter)
    probed = staged(queries.mapInPandas(probe, "query_id long, list int, q array<double>, bound double, vec_id long, score double"), "probes")

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted so that the rows of a list part come before the queries that probe it."""
        own = filled.value
        key, held, columns, x, ids, seed = None, [], None, None, None, None
        for frame in frames:
            here = frame["list"].to_numpy() * np.int64(1 << 40) + frame["part"].to_numpy() * np.int64(1 << 20) + frame["turn"].to_numpy()
            kind = frame["bound"].notna().to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (here[1:] != here[:-1]) | (kind[1:] != kind[:-1]), [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                some = frame.iloc[lo:hi]
                if here[lo] != key:
                    key, held, columns = here[lo], [], None
                if not kind[lo]:
                    held.append((_matrix(some["v"]), some["id"].to_numpy()))
                    continue
                if not held:
                    continue
                if columns is None:
                    x, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    columns, seed = np.ascontiguousarray((own.lift(x) @ own.rotation).T), np.isin(ids, own.seed_ids)
                for at in range(0, len(some), QUERY_ROWS):
                    asked = some.iloc[at : at + QUERY_ROWS]
                    qs, query, bound = _matrix(asked["v"]), asked["id"].to_numpy(), asked["bound"].to_numpy()
                    turned = np.concatenate([qs, np.zeros((len(qs), 1))], 1) @ own.rotation
                    q_at, r_at = scan(columns, turned, own.longest**2 + (qs * qs).sum(1) - 2 * bound)
                    # the seeds of a bound are hits already, and other seeds do not reach it
                    fine = (query[q_at] != ids[r_at]) & ~(seed[r_at] & np.isfinite(bound[q_at]))
                    q_at, r_at = q_at[fine], r_at[fine]
                    score = pair_scores(qs, x, q_at, r_at)
                    fine = score >= bound[q_at]
                    q_at, r_at, score = q_at[fine], r_at[fine], score[fine]
                    top = best_of_each(q_at, score, ids[r_at], k)
                    yield pd.DataFrame({"query_id": query[q_at[top]], "vec_id": ids[r_at[top]], "score": score[top]})

    asked = probed.where("list >= 0")
    # a row for each list, as many as the model has at most
    plan = dealt.groupBy("list").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("parts")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / LIST_QUERIES).cast("int").alias("turns")), "list")
    plan = F.broadcast(staged(plan, "list-plan"))
    held = dealt.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("double").alias("bound"), F.col("vec_id").alias("id"), "v")
    asked = asked.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "turns").cast("int").alias("turn"), "bound", F.col("query_id").alias("id"), F.col("q").alias("v"))
    rows = held.unionByName(asked).repartition("list", "part", "turn").sortWithinPartitions("list", "part", "turn", F.asc_nulls_first("bound"))
    hits = rows.mapInPandas(stream, HITS)
    first = probed.where("list = -1").select("query_id", "vec_id", "score")
    if with_seeds:
        hits = hits.unionByName(first)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
