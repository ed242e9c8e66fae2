import io
import zipfile

import pytest

from pyspark.sql import functions as F

from docquarry.operators import cache, context, embedding, records
from docquarry.plans.engine import Engine, Settings
from docquarry.sources import files
from docquarry.streaming import jobs

ENTRY = "entry_id long, query_vector array<double>, user_id string, model_hash string, version int, doc_ids array<string>, doc_versions map<string,bigint>, created_at timestamp"


def entries(spark, rows):
    return spark.createDataFrame([(i, v, u, "m", 1, d, s, None) for i, v, u, d, s in rows], ENTRY).withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))


def test_semantic_cache(spark):
    held = entries(spark, [(1, [0.1, 0.2, 0.3, 0.4], "u", ["A"], {"A": 1}), (2, [0.9, 0.8, 0.7, 0.6], None, [], {})])
    asked = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.41], "u", "m", 1), (2, [0.1, 0.2, 0.3, 0.41], None, "m", 1), (3, [0.9, 0.8, 0.7, 0.6], None, "m", 1)], "query_id long, query array<double>, user_id string, model_hash string, version int")
    now = F.lit("2024-01-03").cast("timestamp")
    changes = spark.createDataFrame([("B",)], "doc_id string")
    hits = lambda log, at=now: {(r.query_id, r.entry_id) for r in cache.cache_lookup(held, asked, cache.document_versions(log), at).collect()}
    assert hits(changes) == {(1, 1), (3, 2)}
    assert hits(spark.createDataFrame([("A",)], "doc_id string")) == {(3, 2)}
    assert hits(changes, F.lit("2024-02-01").cast("timestamp")) == set()
    kept = lambda log: {r.entry_id for r in cache.invalidate(held, spark.createDataFrame(log, "doc_id string")).collect()}
    assert kept([("A",)]) == {2} and kept([("Z",)]) == {1, 2} and kept([(None,)]) == set()
    new = entries(spark, [(3, [1.0], "u", ["A", "B"], {})]).drop("doc_versions", "created_at")
    got = {r.entry_id: r.doc_versions for r in cache.put(held, new, cache.document_versions(changes), now).collect()}
    assert got[3] == {"A": 1, "B": 2} and set(got) == {1, 2, 3}


def test_sessions(spark):
    held = spark.createDataFrame([("a", "u", "2024-01-10 00:00:00", 3), ("b", "u", "2023-11-01 00:00:00", 3), ("c", "u", "2024-01-10 00:00:00", 100)], "session_id string, user_id string, at string, message_count int").select("session_id", "user_id", F.col("at").cast("timestamp").alias("last_activity_at"), "message_count", F.lit(None).cast("timestamp").alias("deleted_at"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    asked = spark.createDataFrame([(1, "a", "u"), (2, "b", "u"), (3, "c", "u"), (4, "a", "x"), (5, None, "u")], "request_id int, session_id string, user_id string")
    assert {r.request_id: r.state for r in cache.resolve_sessions(asked, held, now).collect()} == {1: "resumed", 2: "new", 3: "full", 4: "new", 5: "new"}
    assert [r.session_id for r in cache.expire_sessions(held, now).where("deleted_at IS NOT NULL").collect()] == ["b"]


def test_context(spark):
    hits = spark.createDataFrame([(1, k, "T", "x" * 100, 0.914, 5 if k == 1 else None) for k in (1, 2, 3)], "query_id long, rank int, document_title string, content string, score double, page_number int")
    row = context.pack_context(hits, 60).first()
    assert row.n_chunks == 1 and row.context.startswith("[Source: T (91%)], Page 5\nx") or row.n_chunks == 2
    dates = spark.createDataFrame([("2024-01-05",), ("2022-12-30",), (None,)], "d string").select(F.col("d").cast("date").alias("report_date"))
    asked = spark.createDataFrame([(1, "2024-01-01"), (2, "2023-01-02"), (3, "2030-01-01"), (4, "2023-07-04"), (5, None)], "query_id int, t string").select("query_id", F.col("t").cast("date").alias("target"))
    got = {r.query_id: str(r.nearest) for r in context.nearest_date(dates, asked).collect()}
    assert got == {1: "2024-01-05", 2: "2022-12-30", 3: "2024-01-05", 4: "2024-01-05"}
    note = spark.range(1).select(context.scope_note(F.array(F.lit("Ann")), F.lit(None).cast("string"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")).alias("n"), context.refusal(F.lit("မနေ့က"), F.lit(None).cast("date")).alias("r"), context.system_prompt(F.lit("low"), F.lit(True)).alias("s")).first()
    assert note.n == "Search scope:\n- Users: Ann\n- Date range: 2024-01-01 to 2024-01-02" and note.r.startswith("ဆိုင်ရာ") and "11." in note.s and "12." in note.s


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(embedding.HashingProvider):
        def embed_batch(self, texts):
            calls.add(len(texts))
            return super().embed_batch(texts)

    provider = Counting(8)
    rows = spark.createDataFrame([(1, "hello"), (2, "a b"), (3, "hello"), (4, None)], "id int, content string")
    none = spark.createDataFrame([], "key string, embedding array<double>")
    full, fresh = embedding.embed_cached(rows, none, provider)
    assert fresh.count() == 2 and calls.value == 2
    first = {r.id: r.embedding for r in full.collect()}
    assert first[1] == first[3] and first[4] is None and len(first[2]) == 8
    assert embedding.embed_cached(rows, fresh, provider)[1].count() == 0


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda x, extra="": f"<w:p>{extra}<w:r><w:t>{x}</w:t></w:r></w:p>"
    level = '<w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr>'
    body = p("Title") + p("item", level) + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in {"a.txt": b"plain \xc3\xa9", "b.csv": b"caf\xe9,1", "c.md": b"# H\n**b**", "d.docx": docx(), "e.pdf": b"%PDF-1.4", "f.pdf": b"no", "g.exe": b"MZ", "h.txt": b"", "i.txt": b"plain \xc3\xa9"}.items():
        (tmp_path / "in" / name).write_bytes(raw)
    held = files.validate(files.read_files(spark, str(tmp_path / "in")))
    bad = {r.name: r.problem for r in held.where("problem IS NOT NULL").collect()}
    assert bad == {"f.pdf": "not a PDF", "g.exe": "type not allowed"}  # Spark does not list files of no bytes
    good = held.where("problem IS NULL")
    got = {r.name: (r.text, r.error) for r in files.extract_text(good).collect()}
    assert got["a.txt"][0] == "plain é" and got["b.csv"][0] == "café,1" and got["d.docx"][0] == "Title\n  - item\n| a | b |" and got["e.pdf"] == (None, "no PDF reader is set")
    assert {r.name for r in files.new_content(good, spark.createDataFrame([], "file_hash string")).collect()} == {"a.txt", "b.csv", "c.md", "d.docx", "e.pdf"}
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for _ in range(2):
        jobs.ingest(jobs.file_stream(spark, str(tmp_path / "in"), "*.txt"), lambda b: b.select("path", F.length("content").alias("n")), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_records(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert rows(records.upsert(target, source, ["k"])) == [(1, "a"), (2, "B"), (3, "C")] and rows(records.upsert(target, source, ["k"], update=False)) == [(1, "a"), (2, "b"), (3, "C")]
    page, facts = records.page(target.withColumnRenamed("k", "doc_id"), 2, 1, "v", allowed=("v",))
    assert [r.v for r in page.collect()] == ["a"] and facts == {"total": 2, "last_page": 2, "from": 2, "to": 2}
    names = spark.createDataFrame([("Ko Aung (Lead)",), ("Orion",), ("Orion Plus",), ("",)], "name string")
    asked = spark.createDataFrame([(1, "what did ko aung say on orion plus?"), (2, "nothing")], "query_id int, question string")
    found = records.match_names(asked, names)
    assert {r.name for r in found.collect()} == {"Ko Aung (Lead)", "Orion", "Orion Plus"}
    assert records.longest_match(found.where("name LIKE 'Orion%'")).first().name == "Orion Plus"


def test_engine(spark):
    docs = spark.createDataFrame([(k, f"# Notes\nalpha beta topic{k} " + "filler words here. " * 5, f"Doc {k}", "Ann", "Orion") for k in range(6)], "doc_id long, text string, title string, user_name string, project string").withColumns({"report_date": F.lit("2026-05-01").cast("date"), "created_at": F.lit("2026-05-01").cast("timestamp")})
    engine = Engine(Engine.ingest(docs), settings=Settings(top_k=3, threshold=0.1))
    asked = spark.createDataFrame([(1, "find topic4"), (2, "find topic2")], "query_id long, question string")
    today = F.lit("2026-05-20").cast("date")
    best = {r.query_id: r.doc_id for r in engine.search(asked, today).where("rank = 1").collect()}
    assert best == {1: 4, 2: 2}
    answers = {r.query_id: r for r in engine.ask(asked, today).collect()}
    assert "topic4" in answers[1].answer and answers[1].n_chunks >= 1 and answers[1].confidence in ("high", "low")
    kinds = [e["type"] for e in engine.ask_stream(asked.where("query_id = 1"), today)]
    assert kinds[0] == "status" and kinds[-1] == "done" and "sources" in kinds
    assert jobs.answer_frames([{"type": "done"}]) == ['data: {"type": "done"}\n\n']


def test_sessions_and_repairs(spark):
    aliases = spark.createDataFrame([("k8s", "kubernetes", True)], "alias string, canonical string, active boolean")
    asked = spark.createDataFrame([(1, "compare k8s costs"), (2, "hello k8s")], "query_id long, question string")
    got = [tuple(r) for r in records.query_variants(asked, aliases).orderBy("query_id", "variant").collect()]
    assert got[:2] == [(1, 0, "compare k8s costs"), (1, 1, "compare k8s costs kubernetes")] and got[-1] == (2, 0, "hello k8s")
    docs = spark.createDataFrame([(i, "completed") for i in range(5)], "doc_id long, status string")
    chunks = spark.createDataFrame([(i, i, f"text {i}", [0.0], "old") for i in range(5)], "doc_id long, chunk_id long, content string, embedding array<double>, model_name string")
    vectors = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    first = spark.createDataFrame([(4,), (1,)], "doc_id long")
    assert [r[0] for r in records.repair_selection(first, docs, chunks, vectors, scanned=4, most=2).collect()] == [4, 0]
    provider = embedding.provider_for("hashing", dimensions=8)
    again = {r["doc_id"]: r for r in embedding.reembed(chunks, first, provider).collect()}
    assert {i for i, r in again.items() if r["model_name"] == provider.name} == {1, 4} and len(again) == 5
    assert len(again[4]["embedding"]) == 8 and again[0]["embedding"] == [0.0]
    with pytest.raises(ValueError):
        embedding.provider_for("nobody")
    flags = spark.createDataFrame([(True,), (False,), (None,)], "active boolean")
    assert records.active(flags).count() == 1


def test_factual_questions_use_both_legs(spark):
    docs = spark.createDataFrame([(1, "The budget of alpha is nine.", "A"), (2, "Nothing of that kind stands here.", "B")], "doc_id long, text string, title string")
    docs = docs.withColumns({"user_name": F.lit("u"), "project": F.lit("p"), "report_date": F.lit("2024-01-01").cast("date"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    chunks = Engine.ingest(docs)
    asked = spark.createDataFrame([(1, "what is the budget alpha"), (2, "budget alpha")], "query_id long, question string")
    engine = Engine(chunks, settings=Settings(mode="vector", threshold=0.0, floor=-1.0))
    kinds = {r["query_id"]: r["type"] for r in engine.compile(asked, F.current_date()).select("query_id", "type").collect()}
    got = {r["query_id"]: r for r in engine.search(asked, F.current_date()).where("rank = 1").collect()}
    assert kinds == {1: "factual", 2: "generic"} and set(got) == {1, 2}
    assert got[1]["score"] == 1.0 and got[2]["score"] < 1.0
