import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docquarry.llm import fim_rank
from docquarry.llm.fim_rank import BoundaryBits, fill_in_middle, fim_digests
from tests.llm.helpers import empty_docs, make_docs


def plainly(doc_id, text):
    """The rule, code point by code point."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aé漢👍")), max_size=700))
def test_rank_and_select(text):
    data = np.frombuffer(text.encode(), np.uint8)
    bits = BoundaryBits(data)
    starts = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert bits.total == len(text)
    assert bits.select(np.arange(len(text) + 1)).tolist() == starts
    places = np.arange(len(data) + 1)
    assert bits.rank(places).tolist() == [sum(s < p for s in starts[:-1]) for p in places.tolist()]


@pytest.mark.parametrize("size", [1, 300, 8_000_000])
def test_texts_are_rearranged_and_restored(spark, monkeypatch, size):
    monkeypatch.setattr(fim_rank, "SLICE", size)
    marked = [(i, t, None, None, None, "x", "y", "z", 1) for i, t in [(900, "a <P> b"), (901, "a <S> b"), (902, "<M>"), (903, "<P"), (904, "<<<S<M" * 9), (905, "é" * 40_000), (905, "é" * 40_000)]]
    docs = make_docs(spark, n=80).unionByName(spark.createDataFrame(marked, empty_docs(spark).schema))
    want = Counter(plainly(r.doc_id, r.text) for r in docs.collect())
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in fill_in_middle(docs).collect()) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = Counter((r.doc_id, sha(r.text or "")) for r in docs.collect())
    digests = fim_digests(fill_in_middle(docs)).collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in digests) == texts
    assert Counter(r.output_sha256 for r in digests) == Counter(sha(w[5]) for w in want.elements())


def test_no_rows_and_other_settings(spark):
    assert fill_in_middle(empty_docs(spark)).count() == 0
    docs = make_docs(spark, n=50)
    assert {r.form for r in fill_in_middle(docs, plain_share=0, spm_share=100).where("n > 0").collect()} == {"spm"}
    assert {r.form for r in fill_in_middle(docs, plain_share=100).collect()} == {"plain"}
