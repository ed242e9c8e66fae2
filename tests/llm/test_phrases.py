import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docquarry.llm import phrase_pivot, token_blocks
from docquarry.llm.phrase_pivot import GAP, collocations, fragments_of, mine_rows
from tests.llm.helpers import empty_docs, make_docs


def plainly(rows, least, covered, top):
    """Every phrase counted, language by language."""
    grams = defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                grams[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if len(g) == 2 and any(100 * b >= covered * a for h, b in found.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


def phrase_docs(spark, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "漢字", "x" * 90, "ß", "|", "a\x00b", " "]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        rows.append((i % 100, rng.choice(["en", "de", None, "e.n"]), " ".join(w + rng.choice(["", "", "", ".", ",\n", "\t", " !", "\r", "A"]) for w in words)))
    rows += [(None, None, None), (1, "en", ""), (2, "fr", " \t "), (3, "en", "w0 " * 4000), (4, "en", "the big deal. " * 40), (5, None, "same same same same " * 30)]
    return spark.createDataFrame([(i, t, g, None, None, "x", "y", "z", 1) for i, g, t in rows], empty_docs(spark).schema).repartition(3)


@pytest.mark.parametrize(("ranked", "fragments", "tokens", "mined"), [(400_000, 1_000_000, 4_000_000, 500_000), (5, 20, 50, 1), (0, 3, 500, 10), (12, 1, 100, 100)])
def test_phrases_match_plain_counting(spark, monkeypatch, ranked, fragments, tokens, mined):
    for name, value in (("RANKED", ranked), ("FRAGMENTS", fragments), ("TOKENS", tokens), ("MINED", mined)):
        monkeypatch.setattr(phrase_pivot, name, value)
    docs = phrase_docs(spark)
    got = sorted(tuple(r) for r in collocations(docs, least=4, covered=50, top=60).collect())
    assert got == sorted(plainly([(r.lang, r.text) for r in docs.collect()], 4, 50, 60))
    assert len(got) > 50


def test_settings_and_no_rows(spark):
    docs = make_docs(spark)
    assert collocations(empty_docs(spark)).count() == 0
    assert collocations(docs, least=10**6).count() == 0
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in collocations(docs, least=2, covered=101, top=3).collect()) == sorted(plainly(rows, 2, 101, 3))


def test_every_ngram_has_one_owner():
    rng = np.random.default_rng(1)
    ids = rng.choice([GAP, 0, 1, 2, 3, 4, 9], 400)
    rows = fragments_of(ids, 0, len(ids))
    grams, counts = mine_rows(rows, np.ones(len(rows), np.int64), np.zeros(len(rows), bool), 1)
    want = Counter()
    for k in (2, 3):
        for i in range(len(ids) - k + 1):
            if (ids[i : i + k] != GAP).all():
                want[tuple(ids[i : i + k].tolist()) + (GAP,) * (3 - k)] += 1
    assert {tuple(g): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)} == want


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_blocks_hold_each_token_once_with_its_neighbours(size):
    rng = random.Random(size)
    texts = [(rng.choice("ab"), (" ".join(rng.choice(["x", "yy", ".", "zzzzzzzzzzzz"]) for _ in range(rng.randrange(30)))).encode()) for _ in range(40)]
    want = defaultdict(list)
    for key, text in texts:
        want[key] += phrase_pivot._split(text + b".")
    seen = defaultdict(list)
    for key, tokens, begin, end in token_blocks.token_blocks(iter(texts), phrase_pivot._split, b".", phrase_pivot._DELIMITER, 2, size):
        for at in range(begin, end):
            place = len(seen[key])
            seen[key].append(tokens[at])
            around = ([None] * 2 + want[key] + [b"."] * 2)[place : place + 5]
            assert [tokens[at + d] if at + d >= 0 else None for d in range(-2, 3)] == around
    assert seen == want
