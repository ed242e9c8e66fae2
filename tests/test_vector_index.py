import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators.retrieval import vector_topk_batch
from docquarry.operators.vector_index import VectorIndex, build_index

ROWS = "vec_id long, embedding array<double>, project string, report_date date"


def make_vectors(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist(), "pq"[i % 2], None) for i in range(n)]
    rows += [(n + i, rng.normal(size=4).tolist(), "p", None) for i in range(60)]
    rows += [(900, rows[3][1], "p", None), (901, rows[3][1], "q", None), (902, [0.0] * 8, "p", None), (903, None, "p", None), (904, [float("nan")] + [1.0] * 7, "p", None), (905, [None] + [1.0] * 7, "p", None), (906, [], None, None)]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def plainly(rows, queries, k, keep=lambda q, r: True):
    out = set()
    for qid, q in queries:
        scored = []
        for r in rows:
            v = r.embedding
            if v is None or len(v) != len(q) or any(x is None or math.isnan(x) for x in v) or not keep(qid, r):
                continue
            a, b = np.linalg.norm(v), np.linalg.norm(q)
            scored.append((-round(float(np.dot(v, q)) / (a * b) if a and b else 0.0, 9), r.vec_id))
        out |= {(qid, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def got(found):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()}


@pytest.mark.parametrize("block_bytes", [None, 200])
def test_batch_search_matches_plain_scores(spark, block_bytes):
    held = make_vectors(spark)
    rows = held.collect()
    queries = [(i, rows[i].embedding) for i in range(0, 40, 3) if rows[i].embedding] + [(1000, [0.0] * 8), (1001, [1.0, 2.0])]
    asked = spark.createDataFrame(queries + [(1002, None)], "query_id long, query array<double>")
    assert got(vector_topk_batch(held, asked, 7, block_bytes=block_bytes)) == plainly(rows, queries, 7)
    wanted = asked.withColumn("wanted", F.struct(F.lit(None).cast("array<string>").alias("user_names"), F.when(F.col("query_id") % 2 == 0, "p").alias("project"), F.lit(None).cast("date").alias("date_from"), F.lit(None).cast("date").alias("date_to"), F.lit(None).cast("array<long>").alias("doc_ids")))
    assert got(vector_topk_batch(held, wanted, 7, block_bytes=block_bytes)) == plainly(rows, queries, 7, lambda q, r: q % 2 or r.project == "p")
    assert vector_topk_batch(held.limit(0), asked, 3).count() == 0 == vector_topk_batch(held, asked.limit(0), 3).count()


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    held = make_vectors(spark)
    rows = [r for r in held.collect() if r.embedding and any(x for x in r.embedding)]
    index = build_index(held, str(tmp_path / "index"), lists=12)
    asked = held.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    queries = [(r.query_id, r.query) for r in asked.collect()]
    exact = plainly(rows, queries, 5)
    assert got(index.search(asked, 5, probes=100)) == exact
    some = {(q, i) for q, _, i, _ in got(index.search(asked, 5, probes=3))}
    assert len(some & {(q, i) for q, _, i, _ in exact}) >= 0.9 * len(exact)
    again = VectorIndex(spark, str(tmp_path / "index"))
    kept = got(again.search(asked, 5, probes=100, where=F.col("project") == "q"))
    assert kept == plainly(rows, queries, 5, lambda q, r: r.project == "q")


def test_only_probed_lists_are_read(spark, tmp_path):
    index = build_index(make_vectors(spark), str(tmp_path / "index"), lists=12)
    asked = index.rows.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = index.search(asked, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = {(r.dimensions, r.list) for r in index.rows.where("dimensions = 8").select("dimensions", "list").distinct().collect()}
    assert len(read) > 2 and len({r.vec_id for r in found.collect()}) == 5


def test_index_of_one_vector_many_times_and_of_none(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 1.0], "p", None) for i in range(500)], ROWS)
    index = build_index(same, str(tmp_path / "same"))
    asked = spark.createDataFrame([(1, [2.0, 2.0]), (2, [1.0])], "query_id long, query array<double>")
    assert got(index.search(asked, 3)) == {(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0)}
    assert index.rows.count() == 500
    with_none = make_vectors(spark).where("vec_id = 902")
    assert build_index(with_none.unionByName(same.limit(1)), str(tmp_path / "few")).rows.count() == 1


def test_index_over_random_vectors_has_stated_recall(spark, tmp_path):
    rng = random.Random(3)
    held = spark.createDataFrame([(i, [rng.gauss(0, 1) + (i % 5) for _ in range(16)], "p", None) for i in range(2000)], ROWS)
    index = build_index(held, str(tmp_path / "index"))
    asked = held.where("vec_id % 49 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r.query_id, r.vec_id) for r in vector_topk_batch(held, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 10).collect()}
    assert 1 < index.probes[16] < 44
    assert len(found & exact) >= 0.9 * len(exact)
