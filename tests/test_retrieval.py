import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.functions import questions
from docquarry.functions.vectors import cosine
from docquarry.operators import ranking, retrieval


def ranked(spark, scores, name="a"):
    return spark.createDataFrame([(1, k + 1, c, float(s)) for k, (c, s) in enumerate(scores)], "query_id long, rank int, chunk_id string, score double")


@pytest.mark.parametrize(
    "left,right,k,want",
    [
        ([], [], 70, []),
        ("ab", "", 70, [("a", 1.0), ("b", 0.983871)]),
        ("", "x", 70, [("x", 1.0)]),
        ("ab", "bc", 70, [("b", 1.0), ("a", 0.504065), ("c", 0.495935)]),
        ("abc", "", 2, [("a", 1.0), ("b", 0.983871)]),
        (["v1", "v2"], ["f1", "f2"], 4, [("v1", 1.0), ("f1", 1.0), ("v2", 0.983871), ("f2", 0.983871)]),
    ],
)
def test_fusion(spark, left, right, k, want):
    a, b = (ranked(spark, [(c, 0.5) for c in side]) for side in (left, right))
    got = [(r.chunk_id, round(r.score, 6)) for r in retrieval.fuse(a, b, k).orderBy("rank").collect()]
    assert got == want


@pytest.mark.parametrize(
    "scores,base,kept",
    [
        ([0.95, 0.92, 0.70, 0.68], 0.65, 3), ([0.95, 0.92, 0.70, 0.68], 0.45, 3), ([0.90, 0.88, 0.86, 0.50], 0.65, 3), ([0.90, 0.88, 0.86, 0.50], 0.45, 4),
        ([0.50, 0.48, 0.46], 0.65, 1), ([0.50, 0.48, 0.46], 0.45, 3), ([0.20, 0.19], 0.65, 0), ([0.90], 0.65, 1), ([0.1], 0.65, 1), ([], 0.65, 0),
    ],
)
def test_elbow(spark, scores, base, kept):
    got = ranking.elbow_cut(ranked(spark, [(str(k), s) for k, s in enumerate(scores)]), base).orderBy("rank").collect()
    assert [r.score for r in got] == scores[:kept]


def test_cosine(spark):
    rows = [([0.1, 0.2, 0.3, 0.4], [0.1, 0.2, 0.3, 0.41], 0.999924), ([0.1, 0.2, 0.3, 0.4], [0.9, 0.8, 0.7, 0.6], 0.842701), ([1.0, 2.0], [0.0, 0.0], 0.0)]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.c - r.want) < 1e-6 for r in frame.select("want", cosine(F.col("a"), F.col("b")).alias("c")).collect())


def test_rerank_rules(spark):
    class Fixed:
        def __init__(self, found):
            self.found = found

        def scores(self, question, texts):
            if self.found is None:
                raise TimeoutError
            return self.found

    hits = spark.createDataFrame([(1, "q", k + 1, c, s, c) for k, (c, s) in enumerate(zip("ABCD", (0.9, 0.8, 0.7, 0.6), strict=True))], "query_id long, question string, rank int, chunk_id string, score double, content string")
    order = lambda found, **kw: [(r.chunk_id, r.score) for r in ranking.rerank(hits, Fixed(found), **kw).orderBy("rank").collect()]
    assert order({1: 0.95, 0: 0.30}, candidates=4, final=2) == [("B", 0.95), ("C", 0.7)]
    assert [c for c, _ in order({99: 1.0})] == list("ABCD") == [c for c, _ in order(None)] == [c for c, _ in order({})]


def test_mmr_prefers_new_words(spark):
    rows = [(1, 1, "a", 0.9, "x y z"), (1, 2, "b", 0.89, "x y z"), (1, 3, "c", 0.5, "other words")]
    got = ranking.diversify(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, score double, content string"), 2)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == ["a", "c"]


def test_edges_first(spark):
    got = ranking.edges_first(ranked(spark, [(c, 1) for c in "ABCD"])).orderBy("place").collect()
    assert [r.chunk_id for r in got] == list("ABDC")
    assert [r.chunk_id for r in ranking.edges_first(ranked(spark, [(c, 1) for c in "AB"])).orderBy("place").collect()] == list("AB")


def test_filters(spark):
    rows = spark.createDataFrame([(1, 5, "p", {"section": "s"}), (2, 6, "p", {}), (3, 5, None, {"section": "s"})], "doc_id long, user_id long, project string, metadata map<string,string>")
    ids = lambda where: sorted(r.doc_id for r in rows.where(retrieval.filters(where)).collect())
    assert ids({}) == [1, 2, 3] and ids({"user_ids": [5]}) == [1, 3] and ids({"project": "p", "meta": {"section": "s"}}) == [1]
    with pytest.raises(ValueError):
        retrieval.filters({"meta": {"nothing": 1}})
    assert retrieval.merge_filters({"project": "a", "user_ids": [9]}, {"document_ids": [1], "user_ids": [8]}, 7) == {"project": "a", "user_ids": [7], "document_ids": [1]}


def test_term_ranks(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red"), (3, "blue"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Red"), (2, "red"), (2, "fox")], "query_id long, term string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.text_topk(docs, asked, 5).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and abs(got[(1, 2)] - 0.0607927) < 1e-6


def test_batch_search_is_one_scan_and_group_limit(spark):
    held = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    found = retrieval.vector_topk_batch(held, held.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.vec_id for r in found.where("query_id = 8").collect()} == {8, 7, 6}


def test_own_filters_hold_on_both_legs(spark):
    rows = [(1, "Ann", "p", "2024-01-05"), (2, "Bo", "p", "2024-03-05"), (3, "Bo", "q", None)]
    held = spark.createDataFrame([(i, u, p, d, "red", [1.0, float(i)]) for i, u, p, d in rows], "doc_id long, user_name string, project string, d string, text string, embedding array<double>").withColumns({"report_date": F.col("d").cast("date"), "vec_id": F.col("doc_id")})
    kinds = "user_names: array<string>, project: string, date_from: date, date_to: date, doc_ids: array<long>"
    day = datetime.date
    asked = [(1, (["Ann"], None, None, None, None)), (2, (None, "p", None, None, None)), (3, (None, None, day(2024, 2, 1), day(2024, 12, 31), None)), (4, (None, None, None, None, [3])), (5, (None,) * 5)]
    queries = spark.createDataFrame(asked, f"query_id long, wanted struct<{kinds}>").withColumn("query", F.array(F.lit(1.0), F.lit(0.5)))
    want = {1: {1}, 2: {1, 2}, 3: {2}, 4: {3}, 5: {1, 2, 3}}
    by_text = retrieval.text_topk(held, queries.select("query_id", F.lit("red").alias("term")), 5, wanted=queries)
    for found in (retrieval.vector_topk_batch(held, queries, 5).select("query_id", F.col("vec_id").alias("doc_id")), by_text.select("query_id", "doc_id")):
        got: dict = {}
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.doc_id)
        assert got == want


def test_times_become_dates(spark):
    said = spark.createDataFrame([("what came today?",), ("Yesterday and this week",), ("last week",), ("မနေ့ က",), (None,)], "s string")
    got = said.select(questions.resolve_times(F.col("s"), F.lit("2026-05-20").cast("date")).alias("r")).collect()
    assert [r.r for r in got] == ["what came 2026-05-20?", "2026-05-19 and 2026-05-18 to 2026-05-24", "last week", "2026-05-19 က", None]
