import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import warc
from docquarry.llm.dimension_scan import scan, search_lists
from docquarry.llm.shared import new_folder

VECTORS = "vec_id long, embedding array<double>, list int, score string"


def vectors(seed, n=3000, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.uniform(0.5, 2, (n, 1))
    x[100:400] = x[100]  # one vector shared by many rows
    return x


@pytest.mark.parametrize("rows,lists", [(8192, None), (256, None), (8192, 900)])
def test_recall_and_scores(spark, rows, lists):
    x = vectors(1)
    data = [(i, [float(c) for c in v], 1, "s") for i, v in enumerate(x)]
    data += [(9001, None, 1, "s"), (9020, [0.0] * 16, 1, "s"), (9040, [1.0] * 15 + [None], 1, "s"), (9060, [float("nan")] * 16, 1, "s"), (9080, [1.0] * 3, 1, "s"), (None, [1.0] * 16, 1, "s"), (40, data[40][1], 2, "again")]
    table = spark.createDataFrame(data, VECTORS).repartition(4)
    got = {}
    for r in search_lists(table, F.col("vec_id") % 20 == 0, k=20, sample_rows=rows, list_rows=100, lists=lists).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        score = np.array([float(sum(a * b for a, b in zip(x[q], v))) for v in x])
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score.round(12)))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert np.allclose([f[2] for f in found], score[[f[1] for f in found]], rtol=1e-12)
        hit += len({f[1] for f in found} & set(want.tolist()))
    assert hit / (20 * len(got)) >= 0.95
    copies = [v for _, v, _ in got[120] if 100 <= v < 400]
    assert copies == [v for v in range(100, 121) if v != 120][: len(copies)]  # ties to the smaller id


def test_recall_of_the_scan_alone(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 64))
    table = spark.createDataFrame([(i, v.tolist(), 1, "s") for i, v in enumerate(x)], VECTORS).repartition(4)
    got, want = {}, {}
    rows = search_lists(table, F.col("vec_id") % 20 == 0, with_seeds=False).collect()
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    everything = {(r.query_id, r.vec_id) for r in search_lists(table, F.col("vec_id") % 20 == 0).collect()}
    seeds = everything - {(q, v) for q, found in got.items() for v in found}
    seeds = {v for _, v in seeds if not any(v in found for found in got.values())}
    assert 0 < len(seeds) <= 750 and len(got) == 300
    hit = total = 0
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = set(np.argsort(-score)[:20].tolist()) - seeds
        hit, total = hit + len(want & got[q]), total + len(want)
    assert hit / total >= 0.93


def test_scan_abandons_without_missing_much():
    rng = np.random.default_rng(2)
    rotation = np.linalg.qr(rng.normal(size=(96, 96)))[0]
    x, qs = rng.normal(size=(2000, 96)) * np.geomspace(4, 0.1, 96), rng.normal(size=(30, 96)) * np.geomspace(4, 0.1, 96)
    gaps = ((qs[:, None] - x[None]) ** 2).sum(2)
    bounds = np.sort(gaps, axis=1)[:, 20]
    q_at, r_at = scan(np.ascontiguousarray((x @ rotation).T), qs @ rotation, bounds)
    got, want = set(zip(q_at.tolist(), r_at.tolist())), set(zip(*(a.tolist() for a in np.nonzero(gaps <= bounds[:, None]))))
    assert got <= want | set(zip(*(a.tolist() for a in np.nonzero(gaps <= bounds[:, None] * (1 + 1e-6) + 1e-6)))) and len(got & want) >= 0.95 * len(want)


def test_small_and_empty_vectors(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)], 1, "s") for i in range(5)], VECTORS)
    rows = search_lists(table, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(rows)] == [(0, k + 1, k + 1) for k in range(4)]
    one = spark.createDataFrame([(0, [1.0], 1, "s")], VECTORS)
    assert search_lists(one, F.col("vec_id") % 20 == 0).count() == 0
    assert search_lists(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def pages(spark):
    rng = random.Random(4)
    rows = [(k, f"https://Host{k % 3}.example.com:80/p/{k % 7}?q={k}#top", "é<p>" * rng.randrange(0, 400)) for k in range(60)]
    rows += [(100 + k, "http://same.org/x", "same " * 300) for k in range(9)] + [(200, None, None), (201, "not a url\r\n", "x\r\n\r\nWARC/1.1\r\n" * 99), (None, "http://n.org", "n" * 2000), (5, rows[5][1], rows[5][2]), (300, "http://same.org/x", "short"), (301, "http://same.org/x", "short")]
    return rows, spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, file string, length int").repartition(3)


def test_round_trip(spark):
    rows, table = pages(spark)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(table).collect())
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            last[b] = max(last.get(b, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and last[b] >= 0 and last[b] != i
        want.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    assert got == sorted(want, key=lambda r: (*r[:5], r[5] or 0)) or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_round_trip(spark.createDataFrame([], table.schema)).count() == 0


def test_lookup_by_url_and_blocks(spark):
    rows, table = pages(spark)
    archives, folder = new_folder(spark, "a"), new_folder(spark, "i")
    captures = warc.write_archives(warc.with_record_types(table), archives)
    index = warc.build_index(captures, archives, folder, block_lines=3, lines_per_file=20)
    assert len(index.files) > 1
    asked = spark.createDataFrame([("http://SAME.org/x#y",), ("https://nowhere.org/",)], "url string").select(warc.url_key(F.col("url")).alias("key"))
    found = warc.read_records(warc.lookup(index, asked), archives).collect()
    assert sorted(r.page_id for r in found) == [*range(100, 109), 300, 301]
    assert all(r.payload == dict((i, h) for i, _, h in rows)[r.page_id] for r in found if r.record_type == "response")


def test_url_keys(spark):
    urls = {"http://www.A.com/b?c#d": "com,a,www)/b?c", "https://u:p@a.b.co.uk:443": "uk,co,b,a)/", "a.org?x=1": "org,a)/?x=1", None: ")/"}
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("k"))
    assert {r.url: r.k for r in frame.collect()} == urls
