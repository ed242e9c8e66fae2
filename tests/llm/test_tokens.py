import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from docquarry.llm import token_ids
from docquarry.llm.best_fit import best_fit_plan, pack_best_fit, token_pieces
from docquarry.llm.token_ids import default_path, encoder
from docquarry.llm.token_prefix import PrefixCounts, prefix_token_counts
from tests.llm.helpers import empty_docs, make_docs

TEXTS = ["Hello, world's  foo\tbar.\n\nΣΑΣ é é .. !!, x<|endoftext|>y <| a123 don't. İx", "", " ", "a" * 300 + " ÀB. ÉA, don't, it's.", "İ. ß, ÀÉ,", "a\x01b c", "\x01", "A<|ENDOFTEXT|>b <|StartOfText|>C<|endoftext|>", "…, a.. b.,\r\n　x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.mark.parametrize("text", TEXTS)
def test_prefix_counts_match_the_library(library, text):
    table = PrefixCounts(encoder(default_path()), text)
    every = table.every()
    for k in range(len(text) + 1):
        n = len(library.encode(text[:k], add_special_tokens=False).ids)
        assert every[k] == n == table.at(k)
    for budget in range(table.total + 2):
        assert table.fits(budget) == max(k for k in range(len(text) + 1) if every[k] <= budget)


LONG_TEXTS = ["abcxyzthequickbrownfoxaaaaaaaaaa" * 9, "don're'll..'s'sale1a2B--__==//+AbC'", "A<|endoftext|>b<|startoftext|>C..<|endof", "straßeÀÉİıΣσ漢字仮名", "e\u0301a-\u1112\u1161\u11ab" * 4, "👍🏽👍😂😂😂😂😂😂x", "-=" * 40 + "ing" * 30]


@pytest.mark.parametrize("text", [*TEXTS, *LONG_TEXTS, "one " + " two ".join(LONG_TEXTS)])
def test_prefix_counts_inside_long_words(library, monkeypatch, text):
    monkeypatch.setattr(token_ids, "LONG", 2)
    table = PrefixCounts(encoder(default_path()), text)
    every = table.every()
    composed = unicodedata.is_normalized("NFC", text)
    assert table.total == len(library.encode(text, add_special_tokens=False).ids) == every[-1]
    for k in range(len(text) + 1):
        if composed or not (k < len(text) and text[k] in "\u0301\u1161\u11ab"):
            assert every[k] == len(library.encode(text[:k], add_special_tokens=False).ids)
    for budget in range(0, table.total + 2, 1 + table.total // 20):
        assert table.fits(budget) == max(k for k in range(len(text) + 1) if every[k] <= budget)


def test_long_words_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(token_ids, "LONG", 2)
    monkeypatch.setattr(token_ids, "STEP", 700)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list(letters), n)) for n in (2500, 6000) for letters in ("abcdefghijklmnopqrstuvwxyzé", "aab", "漢字仮名交文", "-=+'/.", "aB3-'s", "😂👍")]
    texts += [" ".join(texts), "ing" * 2000, "a" * 5000, "<|endoftext|>".join(texts)]
    for text in texts:
        got = b"".join(encoder(default_path()).ids_by_word([text])[0])
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_word_takes_bounded_work(library):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", np.uint8)
    blob = letters[rng.integers(0, 64, 300_000)].tobytes().decode()
    runs = "".join(rng.choice(["the", "quick", "zx", "ingly"], 80_000))
    for text in (blob, "so " + runs, "=" * 400_000):
        enc = encoder(default_path())
        held = len(enc.table)
        table = PrefixCounts(enc, text)
        k = table.fits(2048)
        count = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids)
        assert count(k) <= 2048 and all(count(n) > 2048 for n in range(k + 1, k + 40))
        assert len(enc.table) <= held + 2


def test_prefix_operator(spark, library):
    docs = make_docs(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = prefix_token_counts(docs, budget=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) and r.word_counts[-1] == r.n_tokens for r in got)
    assert prefix_token_counts(empty_docs(spark)).count() == 0


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k, room in enumerate(bins) if room >= n), key=lambda k: bins[k], default=None)
        if best is None:
            bins.append(capacity - n)
        else:
            bins[best] -= n
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 20, 64]))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 200)).tolist()
    runs, bins = best_fit_plan(Counter(lengths), capacity)
    assert bins == naive_best_fit(lengths, capacity)
    places, placed = {}, Counter()
    for length, _, n, first, each, offset in runs:
        for j in range(n):
            places.setdefault(first + j // each, []).append((offset + j % each * length, length))
            placed[length] += 1
    assert placed == Counter(lengths) and sorted(places) == list(range(bins))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_round_trip(spark, library):
    docs = make_docs(spark)
    rows = pack_best_fit(token_pieces(docs, capacity=64), capacity=64, rows_per_salt=10).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 64):
            want[(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) == naive_best_fit([r.length for r in rows], 64)
    assert pack_best_fit(token_pieces(empty_docs(spark))).count() == 0
