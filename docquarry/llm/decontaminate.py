"""Benchmark items inside documents, by size-partitioned MinHash containment.

DataFrame functions only. Items are partitioned by the size of their shingle sets
(powers of two). The signature of an item holds its k smallest shingle hashes,
with k set for each partition: an item of at most u shingles that a document
contains to a share of t or more misses at most floor((1 - t) u) of them there, so
with k = floor((1 - t) u) + 1 at least one hash of the signature is among the
document's. Every such item is therefore a candidate: the search has full recall, and
only the signatures (a fifth of the items' shingles) are matched against the
corpus. Candidates are verified by exact containment of shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import text_of
from docquarry.llm.shingles import shingle_hashes, shingle_places, shingle_texts, word_list

#: Signatures and items are broadcast up to so many rows; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def item_sets(items: DataFrame) -> DataFrame:
    """``item_id, shingles, n`` of items with a shingle; rows of one id count as one text each."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), word_list(text_of()).alias("words")).dropDuplicates()
    sets = words.select("item_id", shingle_texts(F.col("words"), shingle_places(F.col("words"))).alias("shingles"))
    return sets.select("item_id", "shingles", F.size("shingles").alias("n")).where("n > 0")


def item_signatures(sets: DataFrame, share: float) -> DataFrame:
    """``item_id, hash``: the smallest hashes of each item, as many as its size partition asks for."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1
    k = F.floor(F.lit(1 - share + 1e-9) * top) + 1
    split = F.transform("shingles", lambda s: F.xxhash64(F.split(s, " ")))
    return sets.select("item_id", F.explode(F.slice(F.array_sort(split), F.lit(1), k.cast("int"))).alias("hash")).dropDuplicates()


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """With a broadcast hint if counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """``doc_id, item_id, containment`` for every document and item of which the
    document holds ``share`` or more of the distinct five-word shingles.

    Null texts are empty. Items and documents of fewer than five words match
    nothing. Repeated document rows repeat their results; an item id with several
    texts matches by any of them (the largest containment). Empty tables give
    no rows. Other columns are not read.
    """
    return _contained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), items, share)


def _contained(rows: DataFrame, items: DataFrame, share: float) -> DataFrame:
    sets = item_sets(items)
    signatures = item_signatures(sets, share)
    hashed = rows.select(F.xxhash64("text").alias("key"), word_list(F.col("text")).alias("words"))
    probes = hashed.select("key", F.explode(shingle_hashes(F.col("words"), shingle_places(F.col("words")))).alias("hash"))
    candidates = probes.join(_maybe_broadcast(signatures), "hash").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    # a text's candidates are bounded by its own length; equal texts share a key and are verified each
    asked = rows.withColumn("key", F.xxhash64("text")).join(candidates, "key")
    words = asked.select("doc_id", "items", word_list(F.col("text")).alias("words"))
    own = words.select("doc_id", "items", shingle_texts(F.col("words"), shingle_places(F.col("words"))).alias("own"))
    pairs = own.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc"), "own", F.explode("items").alias("item_id"))
    shared = F.size(F.array_intersect("shingles", "own"))
    found = pairs.join(_maybe_broadcast(sets), "item_id").select("doc", "item_id", (shared / F.col("n")).alias("containment")).where(F.col("containment") >= share - 1e-12)
    return found.groupBy("doc", "item_id").agg(F.max("containment").alias("containment")).select("doc.doc_id", "item_id", F.round("containment", 9).alias("containment"))


def contaminated_texts(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """``digest`` (MD5 of the text, null as empty) of documents that hold an item."""
    rows = docs.select(F.md5(text_of()).alias("doc_id"), text_of().alias("text"))
    return _contained(rows, items, share).select(F.col("doc_id").alias("digest")).dropDuplicates()


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, round(hits / n, 9) AS containment
FROM (SELECT doc_id, item_id, count(*) AS hits FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE hits / n >= 0.8 - 1e-12
"""
