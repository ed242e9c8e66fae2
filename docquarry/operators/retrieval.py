"""Vector search, full-text search and their fusion, for one query or many."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.vectors import cosine
from docquarry.operators.filtering import META_KEYS, OWN_FILTERS, facts, filters, merge_filters, passes  # noqa: F401
from docquarry.operators.textsearch import match_terms, postings, text_topk  # noqa: F401
from docquarry.operators.vector_scan import vector_topk_batch  # noqa: F401


def vector_topk(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows most similar to one vector; the threshold applies after the limit. Rows of another length have no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    scored = vectors.where(F.size(vector) == len(query)).withColumn("score", cosine(F.col(vector), q, norm_b=F.lit(length)))
    top = scored.orderBy(F.desc("score"), tie).limit(k)
    return top if threshold is None else top.where(F.col("score") >= threshold)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, key: str = "chunk_id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, rank, key): the best gets 1.

    A key in both lists sums its shares; on equal sums the vector leg goes first, then its rank.
    """
    legs = vector_hits.select("query_id", key, "rank", F.lit(0).alias("leg")).unionByName(text_hits.select("query_id", key, "rank", F.lit(1).alias("leg")))
    summed = legs.groupBy("query_id", key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("sum"), F.min(F.struct("rank", "leg")).alias("at"), F.min("leg").alias("leg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sum"), F.col("at.rank"), "leg", key)
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("score", F.col("sum") / F.max("sum").over(Window.partitionBy("query_id"))).select("query_id", "rank", key, "score")


def merge_variants(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One list from the lists of a query's variants (query_id, variant, rank, key, score): the first seen of each key stays."""
    seen = Window.partitionBy("query_id", key).orderBy("variant", "rank")
    first = hits.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "variant", "rank", key)))


def owned_documents(documents: DataFrame, wanted: DataFrame, owner: Column) -> DataFrame:
    """The wanted documents (doc_id) that the owner has."""
    return wanted.join(documents.where(F.col("user_id") == owner), "doc_id", "left_semi")


def delete_vectors(vectors: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Vectors without those whose key is in ``gone`` (by document, chunk or vector id)."""
    return vectors.join(gone.select(key), key, "left_anti")
