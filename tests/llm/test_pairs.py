import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bucket_refine, chosen_path, components, line_edit
from docquarry.llm.components import connected_components
from docquarry.llm.decontaminate import contained_items
from docquarry.llm.edit_distance import within
from docquarry.llm.shared import staged
from tests.llm.helpers import empty_docs, make_docs, words


def clean(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def shingles(text):
    w = clean(text).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def similar_want(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if clean(rows[a][1]) == clean(rows[b][1]) or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    root = roots(len(rows), links)
    degree = Counter(x for pair in links for x in pair)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, least.get(root[k]), degree[k]) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups=6):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = words(rng, rng.randrange(30, 80)).split(" ")
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(9)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small,block", [(256, 2048), (4, 5)])
def test_chosen_path_finds_every_link(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "BLOCK_TEXTS", block)
    texts = near_copies(5)
    docs = make_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")).withColumn("grp", F.lit(1)).withColumn("digest", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.similar_classes(docs).collect())
    assert got == similar_want(rows)


def test_contracted_links_tie_the_same_nodes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 60, 300):
        a, b = rng.integers(0, 200, n), rng.integers(0, 200, n)
        node, root = chosen_path.contracted(a, b)
        assert roots(200, zip(a.tolist(), b.tolist())) == roots(200, zip(node.tolist(), root.tolist()))
        assert len(np.unique(node)) == len(node)


def test_chosen_path_empty(spark):
    assert chosen_path.similar_classes(empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = roots(400, links)
    assert got == {x: root[x] for a, b in links for x in (a, b) if a != b}


def test_nodes_tied_to_one_root_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    for links, most in (([(5, 1), (6, 1), (1, 7), (9, 8), (9, 9)], 1), ([], 1), ([(2, 1), (3, 2)], 3)):
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        root = roots(10, links)
        assert got == {x: root[x] for a, b in links for x in (a, b) if a != b} and len(rounds) <= most
        rounds.clear()


def test_containment(spark):
    rng = random.Random(8)
    items = [(k, words(rng, rng.randrange(5, 60))) for k in range(12)] + [(50, "too short"), (51, None), (52, ""), (3, words(rng, 20))]
    docs = [(k, words(rng, rng.randrange(0, 400))) for k in range(20)]
    for k in range(12):
        held = items[k][1].split(" ")
        for _ in range(k % 4):
            held[rng.randrange(len(held))] = "other"
        at = docs[k][1].split(" ")
        docs.append((40 + k, " ".join(at[:9] + [x.upper() + "," for x in held] + at[9:])))
    docs += [(99, None), (None, items[2][1]), (40, docs[20][1]), (98, "")]
    want = {}
    for n, (i, t) in enumerate(docs):
        for j, u in items:
            s = shingles(u)
            if s and len(s & shingles(t)) / len(s) >= 0.8 - 1e-12:
                want[(n, i, j)] = max(want.get((n, i, j), 0), round(len(s & shingles(t)) / len(s), 9))
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, item_id int, key string").repartition(3)
    got = contained_items(table, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id, r.containment) for r in got.collect()) == Counter((i, j, c) for (_, i, j), c in want.items())
    assert len(want) > 5
    assert contained_items(empty_docs(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contained_items(table, spark.createDataFrame([], "item_id long, text string")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def repeats_want(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + 200] for _, b in raws for s in range(len(b) - 199))
    out = Counter()
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\x01" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


def passage_texts(seed):
    rng = random.Random(seed)
    shared = [words(rng, rng.randrange(30, 120)) for _ in range(4)]
    out = []
    for _ in range(40):
        parts = [words(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            parts += [p[rng.randrange(0, 80) : rng.randrange(150, len(p) + 1)], words(rng, rng.randrange(1, 30))]
        out.append(" ".join(parts))
    return [*out, "ab" * 400, "ab" * 300 + "x" * 250, "é" * 260, "y" * 200, "z" * 201]


@pytest.mark.parametrize("bucket,sort,piece,batch", [(4096, 200_000, 1 << 20, 500_000), (3, 4, 1500, 40)])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, monkeypatch, bucket, sort, piece, batch, seed):
    for name, value in {"BUCKET_ROWS": bucket, "SORT_ROWS": sort, "PIECE": piece, "BATCH_ROWS": batch}.items():
        monkeypatch.setattr(bucket_refine, name, value)
    docs = make_docs(spark).select("doc_id", "text", "grp").unionByName(spark.createDataFrame([(200 + k, t, "g") for k, t in enumerate(passage_texts(seed))], "doc_id long, text string, grp string")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many small batches
    try:
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bucket_refine.remove_repeats(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == repeats_want([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_strings_empty(spark):
    assert bucket_refine.remove_repeats(empty_docs(spark)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits, letters="abc"):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        out[k : k + (kind > 0)] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_banded_distance(most):
    rng = random.Random(most)
    left = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 5, 10, 40]))) for _ in range(800)]
    right = [edited(rng, x, rng.randrange(most + 3)) for x in left]
    got = within([x.encode() for x in left], [x.encode() for x in right], most)
    assert got.tolist() == [min(distance(a, b), most + 1) for a, b in zip(left, right)]


@pytest.mark.parametrize("tau,rows", [(2, 2000), (2, 6), (1, 2000), (3, 2000)])
def test_similar_lines(spark, monkeypatch, tau, rows):
    monkeypatch.setattr(line_edit, "KEY_ROWS", rows)
    rng = random.Random(tau)
    lines = []
    for _ in range(25):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 60))).strip()
        lines += [edited(rng, base, rng.randrange(tau + 2), "abcd") for _ in range(rng.randrange(1, 14))]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 5])) for i in range(0, len(lines), 5)], "doc_id long, text string").repartition(4)
    used = sorted({x.strip(" ") for x in lines if len(x.strip(" ").encode()) >= 20})
    lid = {r.line: r.h for r in spark.createDataFrame([(x,) for x in used], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(used)), 2) if distance(used[a].encode(), used[b].encode()) <= tau]
    root = roots(len(used), links)
    degree = Counter(x for pair in links for x in pair)
    least = {}
    for k, x in enumerate(used):
        least[root[k]] = min(lid[x], least.get(root[k], lid[x]))
    want = {lid[x]: (least[root[k]], degree[k]) for k, x in enumerate(used) if degree[k]}
    assert {r.lid: (r.root, r.links) for r in line_edit.similar_lines(docs, tau=tau).collect()} == want


def test_similar_lines_of_a_hot_key(spark):
    # one head for all lines, so that over 20,000 pairs of rows share its keys; tied are only w - y - x of each triple
    rng = random.Random(4)
    head, lines = "every line of the table starts with this", []
    for _ in range(110):
        tail = rng.sample("abcdefghijklmnopqrst", 20)
        w, x = list(tail), list(tail)
        w[3], w[4] = tail[4], tail[3]
        x[12], x[13] = tail[13], tail[12]
        lines += [head + "".join(t) for t in (w, tail, x)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string").repartition(4)
    lid = [r.h for r in spark.createDataFrame(list(enumerate(lines)), "k long, line string").orderBy("k").select(F.xxhash64("line").alias("h")).collect()]
    want = {lid[k + i]: (min(lid[k : k + 3]), 1 + (i == 1)) for k in range(0, len(lines), 3) for i in range(3)}
    assert {r.lid: (r.root, r.links) for r in line_edit.similar_lines(docs).collect()} == want


def test_line_removal(spark):
    boiler = ["All rights are reserved by the house.", "All rights are reserved by the mouse."]
    rng = random.Random(1)
    docs = [(k, f"{words(rng, 12)}\n{boiler[k % 2]}\n{words(rng, 12)}") for k in range(6)]
    copied = "\n".join(words(rng, 10) for _ in range(4))
    docs += [(10, copied), (11, copied), (12, copied + "\nmore words that only this copy has"), (13, "the same line within a text\n" * 3), (14, ""), (15, None), (None, "x")]
    table = spark.createDataFrame([(i, t, 5, "c") for i, t in docs], "doc_id long, text string, n_lines int, cls string").repartition(3)
    got = {r.doc_id: r for r in line_edit.dedup_lines(table).collect()}
    text = dict(docs)
    assert got[0].text == text[0] and got[0].n_removed == 0 and got[0].n_similar == 1
    for k in range(1, 6):
        assert got[k].text == "\n".join(x for x in text[k].split("\n") if x not in boiler) and got[k].n_removed == 1
    for k in (10, 11, 12):
        assert got[k].text == text[k]  # copied documents are not taken apart
    assert got[13].text == "the same line within a text\n" and got[13].n_removed == 2
    assert got[14].text == "" == got[15].text and got[None].text == "x"
    assert len(got) == len(docs) and got[0].cls == "c"
    assert line_edit.dedup_lines(empty_docs(spark)).count() == 0
    awkward = make_docs(spark)
    assert line_edit.dedup_lines(awkward).count() == awkward.count()


def test_lines_go_whatever_stands_around_them(spark):
    rng = random.Random(2)
    name = lambda: words(rng, 8, 10**6)
    hot, footer, paragraph, twice, near = name(), name(), name(), name(), [name() for _ in range(4)]
    docs = {}
    for k in range(40):
        body = [name() for _ in range(12)]
        # the hot line between few neighbours, a paragraph between blank lines, a footer after a short line
        docs[k] = [*body[:4], near[k % 2], hot, near[2 + k % 2], *body[4:8], "", paragraph, "", *body[8:], "--", footer]
        if k in (8, 30):
            docs[k].insert(2, twice)
    docs[50] = [x for x in docs[5] if x != docs[5][1]]  # near copies of 5 and 0, by whole lines and by words
    docs[51] = [x if i % 5 else x + " more" for i, x in enumerate(docs[0])]
    docs[52] = [hot, footer]  # nothing but repeated lines
    got = {r.doc_id: r for r in line_edit.dedup_lines(spark.createDataFrame([(k, "\n".join(x)) for k, x in docs.items()], "doc_id long, text string").repartition(3)).collect()}
    shingled = {k: shingles("\n".join(x)) for k, x in docs.items()}
    like = lambda a, b: len(shingled[a] & shingled[b]) / len(shingled[a] | shingled[b]) >= 0.5
    assert like(50, 5) and like(51, 0) and not like(52, 0)
    first = {}
    for k, x in docs.items():
        for line in x:
            first.setdefault(line, k)
    for k, x in docs.items():
        want = [line for line in x if len(line) < 20 or first[line] == k or like(first[line], k)]
        assert got[k].text.split("\n") == (want or [""]) and got[k].n_removed == len(x) - len(want)
    assert [sum(line in r.text.split("\n") for r in got.values()) for line in (hot, paragraph, twice)] == [1, 2, 1] and got[50].text.count(docs[5][0]) == 1


def test_text_likeness():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (40, 300, 3000)] + ["", "-- --", "one two", "é ß Σ 漢字 A_b " * 3]
    for text in texts:
        w = clean(text).split()
        other = " ".join("x" if i % 37 == 5 else x for i, x in enumerate(w))
        a, b = shingles(text), shingles(other)
        want = len(a & b) / len(a | b) if a | b else float(w == other.split())
        assert abs(line_edit.likeness(line_edit.sketch_of(text), line_edit.sketch_of(other)) - want) <= (0.08 if len(a | b) > line_edit.SKETCH else 0)


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 800).astype(np.uint64)
    a, b = np.concatenate([shared, rng.integers(0, 1 << 60, 100).astype(np.uint64)]), np.concatenate([shared, rng.integers(0, 1 << 60, 100).astype(np.uint64)])
    assert abs((chosen_path.minhash(a) == chosen_path.minhash(b)).mean() - 0.8) < 0.12
