"""Steps whose work must grow no faster than their input, with the results of a plain computation."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.functions.vectors import cosine
from docquarry.operators import chunking, records, retrieval, text_scan, textsearch


@pytest.mark.parametrize("few,listed", [(200, 2000), (0, 2000), (0, 0)])
def test_names_are_found_in_long_texts(spark, monkeypatch, few, listed):
    monkeypatch.setattr(records, "FEW_NEEDLES", few)
    monkeypatch.setattr(records, "LISTED_GRAMS", listed)
    rng = random.Random(1)
    texts = {k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é", k=n)) for k, n in enumerate((0, 1, 2, 3, 50, 150_000))}
    names = sorted({texts[5][i : i + n] for i, n in ((0, 9), (70_000, 5), (149_998, 2), (149_999, 1))} | {"zzzzzzzz", "é", "ab"})
    asked = spark.createDataFrame(list(texts.items()), "query_id long, q string")
    found = records.containing(asked, spark.createDataFrame([(n,) for n in names], "needle string"))
    assert sorted((r.query_id, r.needle) for r in found.collect()) == sorted((k, n) for k, t in texts.items() for n in names if n in t)


def plain_near(words, groups):
    """Score of a text (words in order) for a search (groups of (term, negated)), or None."""
    held = set(words)
    if not all(any((t in held) != no for t, no in g) for g in groups):
        return None
    asked = {t for g in groups for t, _ in g}
    if len(asked) == 1:
        return 0.1 * sum(1 / (j * j) for j in range(1, words.count(min(asked)) + 1)) / 1.64493406685
    at = [(i, w) for i, w in enumerate(words) if w in asked]
    far = [math.log1p(-math.sqrt(0.01 / (1.005 + 0.05 * math.exp((j - i) / 1.5 - 2)))) for n, (i, a) in enumerate(at) for j, b in at[n + 1 :] if a != b and j - i <= 100]
    return 1 - math.exp(sum(far))


@pytest.mark.parametrize("small", [False, True])
def test_searches_meet_texts_in_the_scan(spark, monkeypatch, small):
    if small:
        for name, value in (("TEXTS", 3), ("WORDS", 40), ("AT_ONCE", 5), ("KEPT", 8), ("BLOCK_TERMS", 30)):
            monkeypatch.setattr(text_scan, name, value)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)]
    texts = [(k, " ".join(rng.choices(vocabulary, weights=range(1, 26), k=rng.choice((0, 1, 5, 40, 260))))) for k in range(60)]
    texts += [(100 + k, texts[9][1]) for k in range(15)] + [(200, None)]
    searches = {}
    for q in range(40):
        groups = [[(t, rng.random() < 0.25) for t in rng.sample(vocabulary, rng.choice((1, 1, 2, 3)))] for _ in range(rng.choice((2, 2, 3, 5)))]
        searches[q] = [[(vocabulary[-1], False), ("nowhere", False)], *groups] if q % 3 else [[("w24", False)], [("w23", False), ("w20", False)]]
    searches[40] = [[("w22", False)], [("w22", False)]]
    rows = [(q, n, t, no) for q, groups in searches.items() for n, g in enumerate(groups) for t, no in g]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(rows, "query_id long, group int, term string, negated boolean")
    for k in (3, None):
        found = textsearch.search_texts(docs, asked, k, groups="several")
        got = {(r.query_id, r.rank, r.doc_id): r.score for r in found.collect()}
        want = {}
        for q, groups in searches.items():
            scored = [(-round(s, 9), i, s) for i, t in texts if (s := plain_near((t or "").split(), groups)) is not None]
            want |= {(q, n, i): s for n, (_, i, s) in enumerate(sorted(scored)[:k], 1)}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_a_search_with_a_floor_scores_few_texts(monkeypatch):
    rng = random.Random(3)
    texts = [(k, [rng.choice("abcdefghij") if rng.random() < 0.1 else f"x{rng.randrange(400)}" for _ in range(rng.choice((40, 150)))]) for k in range(3000)]
    searches = [[[("a", False)], [("b", False)]], [[("a", False), ("c", False)], [("d", False)], [("e", True)]], [[("nowhere", False), ("f", False)], [("g", False)]]]
    held = pa.table({"first": pa.array([7, 8, 9], pa.int64()), "groups": pa.array([[[{"term": t, "negated": no} for t, no in g] for g in s] for s in searches], pa.list_(pa.list_(pa.struct([("term", pa.string()), ("negated", pa.bool_())])))), "asked": [sorted({t for g in s for t, _ in g}) for s in searches], "anchor": [[t for t, _ in s[0]] for s in searches]})
    block = text_scan.search_block(held)
    scored = []
    plain = text_scan._scores
    monkeypatch.setattr(text_scan, "_scores", lambda block, held, search, text: scored.append(len(search)) or plain(block, held, search, text))
    floors, got = text_scan._Floors(block, 4), {0: [], 1: [], 2: []}
    for low in range(0, 3000, 500):
        batch = pa.array([" ".join(w) for _, w in texts[low : low + 500]])
        for search, text, score in text_scan._met(block, batch, np.repeat(np.arange(3), np.diff(block.anchor_at)), floors, text_scan._Pairs(block.pairs)):
            for q, i, s in zip(search.tolist(), text.tolist(), score.tolist(), strict=True):
                got[q].append((-round(s, 9), low + i))
    meet = 0
    for q, groups in enumerate(searches):
        want = [(-round(s, 9), i) for i, w in texts if (s := plain_near(w, groups)) is not None]
        meet += len(want)
        assert sorted(got[q])[:4] == sorted(want)[:4] and floors.floor[q] == -sorted(want)[3][0]
    assert meet > 1500 and sum(scored) < meet / 4


def test_floors_of_a_part_hold_for_all_texts(spark, monkeypatch):
    monkeypatch.setattr(text_scan, "SEEDED", 0)
    monkeypatch.setattr(text_scan, "PARTS", 2)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((1, 6, 30))))) for k in range(300)]
    texts += [(1000 + k, texts[9][1]) for k in range(15)] + [(2000, None)]
    pairs = {q: rng.sample(vocabulary, 2) for q in range(30)} | {30: ["w1", "nowhere"]}
    asked = spark.createDataFrame([(q, t) for q, p in pairs.items() for t in p], "query_id long, term string")
    found = textsearch.text_topk(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), asked, 5)
    want = {}
    for q, p in pairs.items():
        scored = [(-round(s, 9), i) for i, t in texts if (s := plain_near((t or "").split(), [[(x, False)] for x in p])) is not None]
        want |= {(q, n, i): -s for n, (s, i) in enumerate(sorted(scored)[:5], 1)}
    got = {(r.query_id, r.rank, r.doc_id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_words_of_the_scan_are_the_terms(spark):
    said = ["", None, "  A b\tC\n", "x\u0130Y \u0130", "1\u212a2 \u212a", "na\u00efve \u00c9t\u00e9 \u1e9e\u00df \u017f s", "\u03a3a\u03c2 z\x00q_r-s", "a" * 300]
    want = [r.w or [] for r in spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, s string").coalesce(1).select("k", textsearch.tokens(F.col("s")).alias("w")).orderBy("k").collect()]
    for held in (pa.array(said), pa.array(["zz", *said])[1:], pa.array(said, pa.large_string())):
        assert [[w for w in ws if w] for ws in text_scan._words(held).to_pylist()] == want


def test_boolean_text_is_read_once(spark):
    boolean = spark.range(3).select(F.col("id").alias("query_id"), F.concat(F.lit("(a | b) & c & !d"), F.col("id").cast("string")).alias("boolean"))
    rows = textsearch.search_rows(boolean)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("concat") == 1 and rows.count() == 12


def test_a_search_deals_out_only_its_best_of_each_task(spark):
    docs = spark.range(2000, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit("red green blue").alias("text"))
    search = textsearch.prepared(textsearch.plain_search(spark.createDataFrame([(1, "red"), (1, "blue")], "query_id long, term string")))
    found = text_scan.scan_texts(docs, search.withColumn("first", F.col("query_id")), 4, "doc_id", textsearch.tokens(F.col("text")))
    assert found.count() == 8 and {r.doc_id for r in found.collect()} == {0, 1, 2, 3, 1000, 1001, 1002, 1003}


def test_scores_of_the_scan_are_those_of_the_expression(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(33)]) for k in range(300)]
    rows += [(300 + k, [x * (k + 1) / 7 for x in rows[4][1]]) for k in range(20)]  # as near as the last bits tell
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = held.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    scored = asked.crossJoin(held).withColumn("score", cosine(F.col("embedding"), F.col("query")))
    want: dict = {}
    for r in scored.select("query_id", "vec_id", "score").collect():
        want.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    got: dict = {}
    for r in retrieval.vector_topk_batch(held, asked, 9, digits=None).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {q: sorted(found)[:9] for q, found in want.items()}


def test_the_list_of_a_model_is_cut_before_it_meets_the_queries(spark, tmp_path):
    held = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit(1).alias("label"))
    held.write.parquet(str(tmp_path / "embeddings.parquet"))
    second = catalog._legs(spark, str(tmp_path))[1]
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window") and second.count() == 8 * 15


def test_postings_deal_out_only_ids(spark):
    rows = [(1, "red fox, red"), (2, None), (3, ""), (4, "fox"), (4, "red fox"), (None, "a"), (None, "a b")]
    want = {(1, "red"): [1, 3], (1, "fox"): [2], (4, "fox"): [1, 2], (4, "red"): [1], (None, "a"): [1, 1], (None, "b"): [2]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {(r.doc_id, r.term): r.positions for r in textsearch.postings(docs).collect()} == want
    once = docs.where("doc_id < 4")
    found = textsearch.postings(once)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.term): r.positions for r in found.collect()} == {x: p for x, p in want.items() if x[0] == 1}


def test_chunk_contents_are_cut_only_if_read(spark):
    text = "Ärger. " * 700
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é\nb")], "doc_id long, text string")
    cut = chunking.chunk_texts(docs)
    got = [(r.doc_id, r.chunk_index, r.char_start, r.char_end, r.content) for r in cut.orderBy("doc_id", "chunk_index").collect()]
    assert got == [(i, k, a, b, t[a:b]) for i, t in ((1, text), (4, "é\nb")) for k, (a, b) in enumerate(chunking.cut_points(t, 1000, 200))]
    plan = cut.groupBy("doc_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "substr" not in plan
