"""What happens to a ranked list: cut, diversify, re-rank, order, judge."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.workspace import staged


def elbow_cut(hits: DataFrame, base: Column | float = 0.65, most: int = 10, gap: float = 0.15, scaling: float = 0.85, fallback: float = 0.25) -> DataFrame:
    """Rows of ranked lists (query_id, rank, score) above a cut that each list sets itself.

    If the widest gap of neighbouring scores exceeds ``gap``, the cut is the score just below it,
    else ``scaling`` of the best; never below ``base``. A list of one row stays
    whole; where nothing passes, the best row stays if it has ``fallback``.
    """
    by = Window.partitionBy("query_id")
    order = by.orderBy("rank")
    base = base if isinstance(base, Column) else F.lit(float(base))
    step = F.col("score") - F.lead("score").over(order)
    marked = hits.withColumns({"_next": F.lead("score").over(order), "_gap": F.coalesce(step, F.lit(-1.0))})
    marked = marked.withColumn("_widest", F.max(F.struct(F.col("_gap").alias("g"), (-F.col("rank")).alias("r"), F.col("_next").alias("s"))).over(by))
    marked = marked.withColumns({"_n": F.count("*").over(by), "_top": F.max("score").over(by)})
    cut = F.greatest(base, F.when(F.col("_widest.g") > gap, F.col("_widest.s")).otherwise(F.lit(scaling) * F.col("_top")))
    marked = marked.withColumn("_pass", F.col("score") >= cut)
    marked = marked.withColumn("_any", F.max(F.col("_pass").cast("int")).over(by))
    keep = (F.col("_n") == 1) | (F.col("_pass") & (F.col("rank") <= most)) | ((F.col("_any") == 0) & (F.col("rank") == 1) & (F.col("score") >= fallback))
    return marked.where(keep).select(*hits.columns)


def diversify(hits: DataFrame, k: int, weight: float = 0.7, text: str = "content", candidates: int = 100) -> DataFrame:
    """Maximal marginal relevance: ``k`` of the first ``candidates`` rows of each list, which one task compares with each other.

    Each pick maximises weight * score - (1 - weight) * its largest word overlap with what is picked; ties go to the earlier rank.
    """
    short = hits.where(F.col("rank") <= candidates)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        words = [set(str(t or "").lower().split()) for t in rows[text]]
        left, chosen, near = list(range(len(rows))), [], [0.0] * len(rows)
        while left and len(chosen) < k:
            best = left[0] if not chosen else max(left, key=lambda i: (weight * rows["score"][i] - (1 - weight) * near[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                either = len(words[i] | words[best])
                near[i] = max(near[i], len(words[i] & words[best]) / either if either else 0.0)
        out = rows.iloc[chosen].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return short.groupBy("query_id").applyInPandas(pick, short.schema)


class Reranker(Protocol):
    def scores(self, question: str, texts: list[str]) -> dict[int, float]: ...


class OverlapReranker:
    """Share of the question's words that a text holds."""

    def scores(self, question: str, texts: list[str]) -> dict[int, float]:
        asked = set(question.lower().split())
        return {i: len(asked & set(t.lower().split())) / len(asked) if asked else 0.0 for i, t in enumerate(texts)}


def rerank(hits: DataFrame, reranker: Reranker, candidates: int = 8, final: int = 5) -> DataFrame:
    """Re-scores the first ``candidates`` of each list (query_id, question, rank, score, content) and keeps ``final``.

    A score the re-ranker does not give stays as it was; if it gives none or fails, the list is unchanged.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        some = rows.sort_values("rank").reset_index(drop=True)
        try:
            found = {i: s for i, s in reranker.scores(str(some["question"].iloc[0]), some["content"].fillna("").tolist()).items() if 0 <= i < len(some)}
        except Exception:  # the provider is outside: its failure leaves the order as it is
            found = {}
        if not found:
            return some.assign(_new=False)
        some["score"] = [found.get(i, s) for i, s in enumerate(some["score"])]
        some = some.sort_values(["score", "rank"], ascending=[False, True], kind="stable").head(final)
        some["rank"] = range(1, len(some) + 1)
        return some.assign(_new=True)

    kinds = ", ".join(f"`{c}` {k}" for c, k in hits.dtypes)
    # written once: the provider is asked once for each list
    first = staged(hits.where(F.col("rank") <= candidates).groupBy("query_id").applyInPandas(run, f"{kinds}, _new boolean"), "reranked")
    # lists that stay as they are keep what comes after the candidates
    same = first.where("NOT _new").select("query_id").distinct()
    return first.drop("_new").unionByName(hits.where(F.col("rank") > candidates).join(same, "query_id", "left_semi"))


def confidence(hits: DataFrame) -> DataFrame:
    """``query_id, n, mean_score, confidence``: high for three or more with a mean of 0.6, low for any."""
    n, mean = F.col("n"), F.col("mean_score")
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).withColumn("confidence", F.when((n >= 3) & (mean >= 0.6), "high").when(n >= 1, "low").otherwise("none"))


def edges_first(hits: DataFrame) -> DataFrame:
    """Order for long contexts: best, then the first half, the last, then the rest (A B C D gives A B D C)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    middle = F.floor(n / 2)
    r = F.col("rank")
    place = F.when((n < 3) | (r <= middle), r).when(r == n, middle + 1).otherwise(r + 1)
    return hits.withColumn("place", place.cast("int"))


def has_old_documents(hits: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """``query_id, has_old``: whether a source is over a year old."""
    return hits.groupBy("query_id").agg(F.coalesce(F.bool_or(F.col(created) < F.add_months(now, -12)), F.lit(False)).alias("has_old"))


def citations(hits: DataFrame) -> DataFrame:
    """The best chunk of each document and query, its score to four places and first 200 characters."""
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "rank")
    top = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return top.select("query_id", "doc_id", "chunk_id", F.round("score", 4).alias("score"), F.substring("content", 1, 200).alias("excerpt"))
