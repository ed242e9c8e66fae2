import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.llm.line_crf import LineCrf, fit_quality, forward_backward, line_features, quality_result, quality_scores
from docquarry.llm.toxicity import WIDTHS, Scorer, best_threshold, fit_toxicity, new_model, score_toxicity, toxicity_result, train, winners, word_rows
from tests.llm.helpers import empty_docs, make_docs, words


def labelled(spark, n=700, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [words(rng, rng.randrange(5, 25), 300) for _ in range(rng.randrange(1, 6))]
        toxic, bad = i % 3 == 0, i % 5 == 0
        if toxic:
            lines[0] += f" {rng.choice(['vile', 'awful'])}"
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        rows.append((i, "\n".join(lines), "en" if i % 2 else "de"))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity_result(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = got[got["held_out"]]
    assert (out["predicted"] == out["toxic"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit_toxicity(docs, labels), fit_toxicity(docs, flipped)
    assert (a.embed == b.embed).all() and (a.out == b.out).all()


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(0, 40)) for _ in range(60)]
    model = train(pd.DataFrame({"doc_id": range(60), "text": texts, "y": [i % 2 for i in range(60)], "weight": 1.0}), epochs=2)
    together = Scorer(model).scores(texts)
    alone = np.array([Scorer(model).scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)


def naive_score(model, text):
    """Convolution, pooling and the logistic layer word by word."""
    pad = np.zeros(model.embed.shape[1])
    vectors = [sum(model.embed[r].astype(float) for r in word_rows(w, model.buckets)) for w in text.lower().split()] + [pad] * max(WIDTHS)
    pooled = []
    for width, w in zip(WIDTHS, model.filters, strict=True):
        places = [sum(vectors[at + j] @ w[j] for j in range(width)) for at in range(len(vectors) - width + 1)]
        pooled.append(np.max(places, axis=0))
    hidden = np.maximum(np.concatenate(pooled) + model.bias, 0)
    return 1 / (1 + np.exp(-(hidden @ model.out + model.out_bias)))


def test_scores_match_a_naive_convolution_in_one_piece_or_many():
    rng = random.Random(4)
    texts = ["", " ", "one", *[words(rng, rng.randrange(1, 60)) for _ in range(40)]]
    model = train(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "y": [i % 2 for i in range(len(texts))], "weight": 1.0}), epochs=2)
    want = np.array([naive_score(model, t) for t in texts])
    for at_once in (12_000, 16, 5):
        assert np.allclose(Scorer(model).scores(texts, at_once), want, atol=1e-5)


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 120)
    model, crf = fit_toxicity(docs, labels), fit_quality(docs, labels)
    awkward = make_docs(spark)
    n = awkward.count()
    for frame in (toxicity_result(awkward, model), quality_result(awkward, crf)):
        rows = frame.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_result(empty_docs(spark), model).count() == 0 == quality_result(empty_docs(spark), crf).count()
    assert set(awkward.columns) < set(score_toxicity(awkward, model).columns)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_result(awkward, fit_toxicity(awkward, none)).count() == n == quality_result(awkward, fit_quality(awkward, none)).count()


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    got = quality_result(docs, fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    out = got[got["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    emit, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = forward_backward(emit, moves, counts)
    at, want_z, want_pairs = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        total, hit, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            hit += w * np.array(y)
            for k in range(n - 1):
                moved[y[k], y[k + 1]] += w
        assert np.allclose(good[at : at + n], hit / total)
        want_z += np.log(total)
        want_pairs += moved / total
        at += n
    assert np.isclose(log_z, want_z) and np.allclose(pairs, want_pairs)


def test_quality_is_the_length_weighted_mean():
    own, size, counts = line_features(["ab\nabcd efg", "", "x"])
    assert counts.tolist() == [2, 1, 1] and size.tolist() == [2, 8, 0, 1]
    d = own.shape[1]
    model = LineCrf(np.zeros(3 * d + 1), np.ones(3 * d + 1), np.zeros(3 * d + 1), np.zeros((2, 2)))
    assert np.allclose(quality_scores(model, ["ab\nabcd efg", "", "x"]), 0.5)


def test_every_labelled_row_is_learnt_from(spark):
    """The rows that a sample of 3000 would leave out are the only ones with the words that tell the classes apart."""
    rng = random.Random(6)
    n = 9000
    plain = [(i, " ".join(words(rng, 6, 50).split())) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in plain], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(1500) for y in (0, 1)]
    sample = first[0].unionByName(first[1]).select("doc_id", F.lit(True).alias("sampled"))
    marked = docs.join(labels, "doc_id").join(F.broadcast(sample), "doc_id", "left")
    marked = marked.withColumn("text", F.when(F.col("sampled").isNull() & (F.col("toxic") == 1), F.concat("text", F.lit(" VILE!! VILE!!"))).otherwise(F.col("text"))).select("doc_id", "text", "lang").localCheckpoint()
    asked = spark.createDataFrame([(1, "w1 w2 w3 VILE!! VILE!!", "en"), (2, "w1 w2 w3", "en")], "doc_id long, text string, lang string")
    for result, model in ((toxicity_result, fit_toxicity(marked, labels)), (quality_result, fit_quality(marked, labels))):
        score = {r.doc_id: r.score for r in result(asked, model).collect()}
        assert score[1] > 0.9 and score[2] < 0.6


def test_thresholds_come_from_all_rows_set_aside():
    rows = [(0.05 * k, int(k > 12 or k == 3)) for k in range(20)]
    frame = pd.DataFrame([{"low": s, "high": s, "ones": y * 50, "n": 50} for s, y in rows])
    assert best_threshold(frame, 20) == pytest.approx((0.05 * 13 + 0.05 * 12) / 2)
    assert best_threshold(frame, 401) is None


def test_responses_of_a_long_text_in_pieces():
    rng = np.random.default_rng(8)
    model = new_model()
    texts = [np.concatenate([rng.integers(0, model.buckets, (n, 3)), np.full((max(WIDTHS), 3), model.buckets)]).astype("<u2") for n in (0, 1, 40, 7, 90)]
    best, spots = winners(model, texts)
    for most in (6, 11, 30):
        best_of, spots_of = winners(model, texts, most)
        assert np.allclose(best, best_of, atol=1e-5)
        assert all((a == b).all() for a, b in zip(spots, spots_of))
