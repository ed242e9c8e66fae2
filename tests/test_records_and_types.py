import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.functions import questions as q
from docquarry.functions.containment import json_contains
from docquarry.operators import cache, embedding, records, retrieval, textsearch
from docquarry.sources import files
from docquarry.streaming import jobs

HELD = '{"a": {"k": 7, "s": "7"}, "tags": ["x", 3, {"v": 1.50}], "none": null, "yes": true, "d.e": {"f\'g": 1}}'


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({}, True), ({"a": {}}, True), ({"a": {"k": 7}}, True), ({"a": {"k": 7.0}}, True), ({"a": {"k": "7"}}, False), ({"a": {"s": "7"}}, True), ({"a": {"s": 7}}, False), ({"a": 7}, False),
        ({"tags": ["x"]}, True), ({"tags": [3, "x"]}, True), ({"tags": ["3"]}, False), ({"tags": [{"v": 1.5}]}, True), ({"tags": [{"v": 2}]}, False), ({"tags": []}, True), ({"tags": {}}, False), ({"tags": "x"}, True),
        ({"none": None}, True), ({"missing": None}, False), ({"yes": True}, True), ({"yes": 1}, False), ({"yes": "true"}, False), ([], False), ({"d.e": {"f'g": 1}}, True), ({"a": {"k": 7}, "yes": False}, False),
    ],
)
def test_containment_goes_by_kind(spark, value, want):
    rows = spark.createDataFrame([(HELD,), ("no json {",), (None,)], "j string")
    assert [r.c for r in rows.select(json_contains(F.col("j"), value).alias("c")).collect()] == [want, False, False]


def test_filters_on_typed_metadata(spark):
    rows = spark.createDataFrame([(1, '{"page_number": 3}'), (2, '{"page_number": "3"}'), (3, None)], "doc_id int, metadata string")
    ids = lambda value: {r.doc_id for r in rows.where(retrieval.filters({"meta": {"page_number": value}}, metadata="json")).collect()}
    assert ids(3) == {1} and ids("3") == {2}


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for m in members:
            z.writestr(m, "<x/>")
    return out.getvalue()


def test_types_come_from_the_content(spark):
    docx = archive("[Content_Types].xml", "word/document.xml")
    held = [
        ("a.txt", b"plain \xc3\xa9\n", None, "text", None), ("b.txt", b"%PDF-1.7 x", None, "pdf", "content is pdf"), ("c.pdf", b"plain", None, "text", "not a PDF"), ("d.docx", archive("a.xml"), None, "zip", "not a DOCX"), ("e.docx", docx, None, "docx", None),
        ("f.md", docx, None, "docx", "content is docx"), ("g.csv", b"a\x00b", None, "binary", "content is binary"), ("h.txt", b"caf\xe9 1", "text/plain", "text", None), ("i.txt", b"words", "application/pdf", "text", "not what was declared"),
        ("j.pdf", b"%PDF-1.4", "application/octet-stream", "pdf", None), ("k.txt", b"\xff\xfea\x00b\x00", None, "text", None), ("l.txt", b"\x01\x02\x03\x04abc", None, "binary", "content is binary"),
    ]
    rows = spark.createDataFrame([(f"/in/{n}", n, n.split(".")[1], files.TYPES[n.split(".")[1]], len(c), c, d) for n, c, d, _, _ in held], "path string, name string, ext string, mime string, bytes long, content binary, declared string")
    judged = files.validate(rows)
    assert {(r["name"], r["found"], r["problem"]) for r in judged.collect()} == {(n, f, p) for n, _, _, f, p in held}
    assert {r["name"] for r in files.rejected(judged).collect()} == {n for n, _, _, _, p in held if p}


def test_upsert_takes_the_newest_of_a_key(spark):
    target = spark.createDataFrame([(1, "old", 5)], "k int, v string, at int")
    source = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "x", 1), (2, "y", 1), (3, "n", None), (3, "m", 0)], "k int, v string, at int")
    rows = lambda **kw: {(r.k, r.v) for r in records.upsert(target, source, ["k"], **kw).collect()}
    assert rows(order=["at"]) == {(1, "a"), (2, "y"), (3, "m")}
    assert rows(order=["at"], update=False) == {(1, "old"), (2, "y"), (3, "m")}
    assert rows() == {(1, "b"), (2, "y"), (3, "n")}
    places = records.sorted_rows(source, [("k", "desc"), ("at", "asc"), ("v", "asc")], "place")
    assert [(r.k, r.v) for r in places.orderBy("place").collect()] == [(3, "n"), (3, "m"), (2, "x"), (2, "y"), (1, "b"), (1, "a")]


def test_documents_change_and_go(spark):
    docs = spark.createDataFrame([(1, "t", "p", "/in/a/1", "x"), (2, "u", None, "/in/b/2", "y"), (3, None, None, None, "y")], "doc_id int, title string, project string, file_path string, status string")
    changes = spark.createDataFrame([(1, "new", None, "hacked"), (2, None, "q", None)], "doc_id int, title string, project string, status string")
    assert {(r.doc_id, r.title, r.project, r.status) for r in records.update_documents(docs, changes).collect()} == {(1, "new", "p", "x"), (2, "u", "q", "y"), (3, None, None, "y")}
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, chunk_id string")
    kept, left = records.delete_by_path(docs, chunks, "/in/a")
    assert {r.doc_id for r in kept.collect()} == {2, 3} == {r.doc_id for r in left.collect()}
    owned = retrieval.owned_documents(docs.withColumn("user_id", F.col("status")), docs.select("doc_id"), F.lit("y"))
    assert {r.doc_id for r in owned.collect()} == {2, 3}
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "started"), (1, 3, "done"), (2, 1, "queued"), (2, 2, "started"), (2, 3, "failed"), (2, 4, "started"), (3, 1, "queued")], "doc_id int, at int, event string")
    assert {(r.doc_id, r.status, r.attempts) for r in records.status_of(log).collect()} == {(1, "completed", 1), (2, "processing", 2), (3, "pending", 0)}


def test_aliases_of_terms_and_questions(spark):
    aliases = spark.createDataFrame([("ML", "machine learning", True), ("ml", "maximum likelihood", True), ("k8s", "kubernetes", False)], "alias string, canonical string, active boolean")
    terms = spark.createDataFrame([(1, "Ml"), (1, "k8s")], "query_id int, term string")
    assert {(r.query_id, r.term): r.also for r in records.alias_terms(terms, aliases).collect()} == {(1, "Ml"): ["machine learning", "maximum likelihood"], (1, "k8s"): []}
    asked = spark.createDataFrame([(1, "what is ML, again"), (2, "k8s")], "query_id int, question string")
    assert {r.query_id: r.also for r in records.alias_map(asked, aliases).collect()} == {1: {"ml": "machine learning"}}
    row = spark.range(1).select(
        q.boolean_query(F.lit("Costs of ml မဟုတ် in 2024"), F.create_map(F.lit("ml"), F.lit("machine learning"))).alias("b"), q.fix_spelling(F.lit("ကွန်ပျုတာ x")).alias("s"),
        q.without_names(F.lit("What did KO AUNG and Orion say"), F.array(F.lit("Ko Aung (Lead)")), F.lit("orion")).alias("w"),
    ).first()
    assert row.b == "Costs & of & !(ml | machine learning) & in" and row.s == "ကွန်ပျူတာ x" and row.w.split() == ["What", "did", "and", "say"]


def test_versions_hashes_and_the_embedding_cache(spark):
    changes = spark.createDataFrame([("a",), (None,), (None,)], "doc_id string")
    assert cache.global_version(changes).first().version == 2 and cache.global_version(changes.limit(0)).first().version == 1
    row = spark.range(1).select(cache.model_hash(F.lit("m"), F.lit(0.3), F.lit(100)).alias("a"), cache.model_hash(F.lit("m"), F.lit(0.4), F.lit(100)).alias("b")).first()
    assert len(row.a) == 32 and row.a != row.b
    held = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2, 1))], "key int, created_at timestamp")
    assert {r.key for r in embedding.live_cache(held, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()} == {2}


def test_filters_are_inherited_message_by_message(spark):
    kinds = "session_id string, turn int, user_names array<string>, project string, date_from string, date_to string, refused boolean"
    rows = [("s", 1, ["Ann"], None, "2024-01-01", "2024-01-31", False), ("s", 2, None, None, None, None, True), ("s", 3, None, None, None, None, None), ("t", 1, None, "p", None, None, None)]
    got = {(r.session_id, r.turn): (r.user_names, r.project, r.date_from) for r in cache.inherit_filters(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {("s", 1): (["Ann"], None, "2024-01-01"), ("s", 2): (["Ann"], None, "2024-01-01"), ("s", 3): (None, None, None), ("t", 1): (None, "p", None)}


def test_a_change_stream_hands_on_distinct_ids(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("doc_id string").parquet(str(tmp_path / "in"))
    jobs.on_changes(stream, lambda rows, n: seen.append((n, sorted(r.doc_id for r in rows.collect()))), str(tmp_path / "log")).awaitTermination()
    assert seen == [(0, ["a", "b"])]


TEXTS = [(1, "alpha beta gamma"), (2, "alpha x x x beta"), (3, "Running dogs, the runner ran"), (4, "beta alpha"), (5, ""), (6, None), (7, "solo")]


def test_searches_as_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plain = spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id long, term string")
    got = {r.doc_id: round(r.score, 7) for r in retrieval.text_topk(docs, plain, 9).collect()}
    assert got[1] == got[4] == 0.0991032 and got[2] < got[1] and set(got) == {1, 2, 4}
    asked = spark.createDataFrame([(1, "(alpha | solo) & !gamma"), (2, "alpha & (beta"), (3, "!alpha"), (4, "solo | alpha"), (5, "a & & b"), (6, "beta & alpha & !x & (gamma|solo)"), (7, "ALPHA"), (8, None), (9, "(x)")], "query_id long, boolean string")
    found = {}
    for r in textsearch.search_texts(docs, textsearch.search_rows(asked)).collect():
        found.setdefault(r.query_id, set()).add(r.doc_id)
    assert found == {1: {2, 4, 7}, 4: {1, 2, 4, 7}, 6: {1}, 7: {1, 2, 4}, 9: {2}}
    assert textsearch.search_texts(docs.limit(0), textsearch.search_rows(asked)).count() == 0


def test_stems_find_other_forms(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    ids = lambda words, **kw: {r.doc_id for r in retrieval.text_topk(docs, spark.createDataFrame([(1, w) for w in words], "query_id long, term string"), 9, **kw).collect()}
    assert ids(["dog", "runs"], stem=True) == {3} and ids(["dog", "runs"]) == set() and ids(["the", "dogs"], stem=True) == {3}
    assert {r.doc_id for r in retrieval.match_terms(docs, every=["dog"], none=["gamma"], stem=True).collect()} == {3}
    held = {(r.term): list(r.positions) for r in retrieval.postings(docs.where("doc_id = 3"), stem=True).collect()}
    assert held == {"run": [1], "dog": [2], "runner": [4], "ran": [5]}


@pytest.mark.parametrize(("text", "want"), [("a b", "a & b"), ("word & !x", "word & !x"), ("a) & (b", None), ("a & & b & !", None), ("(a", None), ("x-y 2026-04", "x & y & 2026 & 04"), ("()", None), ("", None), ("(a | b) & c", "(a | b) & c"), ("a (b)", None), ("!(a | b)", "!(a | b)"), ("a |", None)])
def test_boolean_text_is_made_safe(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(q.sanitise_boolean(F.col("t")).alias("s")).first().s == want


@pytest.mark.parametrize(("question", "start", "end"), [("June 31", "2026-06-30", "2026-06-30"), ("Feb 2024-13", None, None), ("ဧပြီလ", "2026-04-01", "2026-04-30"), ("ဧပြီလ ၂၀၂၅ report", "2025-04-01", "2025-04-30"), ("March 2024-05-06", "2024-05-06", "2024-05-06"), ("in 2024 and 2025-03", "2025-03-01", "2025-03-31"), ("May 0", None, None), ("room a2024", None, None)])
def test_more_dates(spark, question, start, end):
    got = spark.createDataFrame([(question,)], "t string").select(q.date_range(F.col("t"), F.lit("2026-05-20").cast("date")).alias("d")).first().d
    assert (got and (str(got["from"]), str(got["to"]))) == (None if start is None else (start, end))
