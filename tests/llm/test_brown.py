import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import brown_lm
from docquarry.llm.brown_lm import best_moves, fit_brown, likelihood, score_texts
from docquarry.llm.shared import arrow_batches
from tests.llm.helpers import empty_docs, make_docs

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def kept_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def grammar_docs(spark, seed=2, n=150):
    """Nouns follow articles, verbs follow nouns: what classes can learn."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(12)] for k in ("the", "Noun", "verb")]
    rows = [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(rng.randrange(3, 60)))) for i in range(n)]
    rows += [(None, "no id here"), (None, None), (n, ""), (n + 1, None), (n + 2, " \t\n "), (3, rows[3][1]), (n + 3, "the1 noun2 verb3 " * 3000), (n + 4, "Unknown\x00word é É " + "z" * 200)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", 1) for i, t in rows], empty_docs(spark).schema).repartition(3)


def test_a_move_gains_what_the_likelihood_says():
    rng = np.random.default_rng(4)
    stream, classes = rng.integers(0, 30, 3000), rng.integers(0, 5, 30)

    def matrix_of(by):
        out = np.zeros((7, 7))
        np.add.at(out, (by[stream], by[np.roll(stream, -1)]), 1)
        return out

    before = matrix_of(classes)
    sums, own = np.zeros((30, 2, 7)), np.zeros(30)
    for v, w in zip(stream, np.roll(stream, -1)):
        sums[v, 0, classes[w]] += 1
        sums[w, 1, classes[v]] += 1
        own[v] += v == w
    best, gain = best_moves(classes, sums, own, before, 5)
    for w in range(30):
        moved = []
        for k in range(5):
            after = classes.copy()
            after[w] = k
            moved.append(likelihood(matrix_of(after)) - likelihood(before))
        assert moved[best[w]] == pytest.approx(max(moved), abs=1e-6)
        assert gain[w] == pytest.approx(max(moved), abs=1e-6)


@pytest.mark.parametrize(("held", "classed", "block"), [(400_000, None, 4_000_000), (10, 4, 4_000_000), (20, 20, 50), (0, 0, 60)])
def test_scores_match_a_plain_model(spark, monkeypatch, held, classed, block):
    monkeypatch.setattr(brown_lm, "HELD", held)
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", block)
    docs = grammar_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for i, t in rows if not kept_out(i) for w in [*words_of(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    model = fit_brown(docs, classes=4, rounds=6, classed=classed)
    assert (model.tokens, model.distinct) == (total, kinds)
    assert model.reached == sorted(model.reached)

    rest = len(model.matrix) - 2
    class_of = {w.decode(): int(c) for w, c in zip(model.words.split(b"\n") if model.words else [], model.classes)} | {"\n": rest + 1}
    size = Counter()
    for w, n in counts.items():
        size[class_of.get(w, rest)] += n
    bigrams = Counter()
    for i, t in rows:
        if not kept_out(i):
            stream = [class_of.get(w, rest) for w in ["\n", *words_of(t), "\n"]]
            bigrams.update(zip(stream, stream[1:]))
    assert {(a, b): int(model.matrix[a, b]) for a, b in zip(*np.nonzero(model.matrix))} == bigrams
    other_kinds = sum(class_of.get(w, rest) == rest for w in counts)

    def p(before, word):
        c, k = counts[word], class_of.get(word, rest)
        own = 1 if word == "\n" else (c + 0.5) / (size[rest] + 0.5 * (other_kinds + 1)) if k == rest else c / size[k]
        return 0.95 * model.transitions()[before, k] * own + 0.05 * (c + 0.5) / (total + 0.5 * (kinds + 1))

    for before in range(len(model.matrix)):  # all words and one unknown one
        assert sum(p(before, w) for w in [*counts, "unknown"]) == pytest.approx(1)
    want = []
    for i, t in rows:
        tokens = [*words_of(t), "\n"]
        befores = [rest + 1] + [class_of.get(w, rest) for w in tokens[:-1]]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        want.append((str(i), kept_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 5), round(sum(math.log10(p(b, w)) for b, w in zip(befores, tokens)), 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in score_texts(docs, model).collect()]
    assert sorted(got) == sorted(want)


def test_classes_beat_words_alone_on_texts_not_learnt_from(spark):
    docs = grammar_docs(spark)
    model = fit_brown(docs, classes=6, rounds=10)
    assert model.reached[-1] > model.reached[0]
    rows = [r for r in score_texts(docs, model).collect() if r.held_out and r.n_tokens > 10]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.3 * sum(r.n_tokens for r in rows)


def test_no_rows_and_nothing_to_learn_from(spark):
    empty = empty_docs(spark)
    assert score_texts(empty, fit_brown(empty)).count() == 0
    only = spark.createDataFrame([(i, "a b", None, None, None, "x", "y", "z", 1) for i in range(60) if kept_out(i)], empty.schema)
    rows = score_texts(only, fit_brown(only)).collect()
    assert rows and all(r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert score_texts(make_docs(spark), fit_brown(make_docs(spark))).where("score >= 0 OR base_score >= 0").count() == 0


def test_neighbours_are_summed_a_bounded_number_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    size, count = 3000, 6
    classes = rng.integers(0, count, size)
    lengths = np.array([0, 1, *rng.integers(0, 2 * size, 97), 2 * size])
    others = [rng.permutation(2 * size)[:n].astype("<i4") for n in lengths]
    n = [rng.integers(1, 9, k).astype("<i8") for k in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(100), pa.int32()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in (others, n)]], names=["id", "others", "n"])
    monkeypatch.setattr(brown_lm, "NEIGHBOURS", 10_000)
    parts = list(brown_lm._bounded([batch.slice(0, 60), batch.slice(60)]))
    assert all(len(brown_lm._values(p.column("others"), "<i4")) <= 10_000 for p in parts) and len(parts) > 20
    whole = brown_lm._class_counts(batch, classes, count)
    for k in range(3):
        assert (np.concatenate([brown_lm._class_counts(p, classes, count)[k] for p in parts]) == whole[k]).all()


def test_rounds_hold_few_neighbours_at_once(spark, monkeypatch):
    held = []
    counts = brown_lm._class_counts
    monkeypatch.setattr(brown_lm, "_class_counts", lambda batch, *more: (held.append(len(brown_lm._values(batch.column("others"), "<i4"))), counts(batch, *more))[1])
    monkeypatch.setattr(brown_lm, "NEIGHBOURS", 50)

    class Rows:  # one task, in this process
        sparkSession = spark

        def __init__(self, batch):
            self.batch = batch

        def mapInArrow(self, f, schema):
            found = pa.Table.from_batches(list(f(iter([self.batch])))).to_pylist()
            return spark.createDataFrame(found, schema)

    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int32()), *[pa.array([np.arange(30, dtype=k).tobytes()] * 40, pa.binary()) for k in ("<i4", "<i8")]], names=["id", "others", "n"])
    brown_lm._matrix(Rows(batch), np.zeros(42, np.int32), 4)
    assert sum(held) == 40 * 30 and max(held) <= 50


def test_few_rows_reach_python_at_a_time(spark, monkeypatch):
    """Texts and words with their neighbours: 10,000 at a time by Spark's default, however large."""
    kind = type(spark.range(0))
    plain = kind.mapInArrow

    def few(self, f, schema, *more):
        def held(batches):
            def checked():
                for batch in batches:
                    assert batch.num_rows <= 20
                    yield batch

            for out in f(checked()):
                assert out.num_rows <= 100
                yield out

        return plain(self, held, schema, *more)

    docs = grammar_docs(spark)
    want = sorted(score_texts(docs, fit_brown(docs, classes=4, rounds=3)).drop("base_score", "score").collect(), key=str)
    monkeypatch.setattr(kind, "mapInArrow", few)
    monkeypatch.setattr(brown_lm, "ROWS", 20)
    monkeypatch.setattr(brown_lm, "SENT", 30)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = sorted(score_texts(docs, fit_brown(docs, classes=4, rounds=3)).drop("base_score", "score").collect(), key=str)
    assert got == want and spark.conf.get(key) == before
    with arrow_batches(spark, 10**9):
        assert spark.conf.get(key) == before
