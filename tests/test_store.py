import pytest
from pyspark.sql import functions as F

from docquarry.sources.store import DocumentStore
from docquarry.streaming import jobs


def parts(spark, docs):
    """Tables of documents given as {doc_id: (chunk texts, vector length)}."""
    d = spark.createDataFrame([(i, f"t{i}", f"/in/{i}.txt") for i in docs], "doc_id long, title string, file_path string")
    c = spark.createDataFrame([(i, f"{i}-{k}", t) for i, (ts, _) in docs.items() for k, t in enumerate(ts)], "doc_id long, chunk_id string, content string")
    v = spark.createDataFrame([(i, f"{i}-{k}", [float(len(t)), 1.0] + [0.0] * (n - 2)) for i, (ts, n) in docs.items() for k, t in enumerate(ts)], "doc_id long, chunk_id string, embedding array<double>")
    return d, c, v


def contents(store):
    return {(r.doc_id, r.chunk_id, r.content) for r in store.table("chunks").collect()}, {(r.doc_id, r.chunk_id) for r in store.table("vectors").collect()}


def test_replacing_a_document_leaves_only_its_new_rows(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=3)
    assert contents(store) == (set(), set()) or store.table("chunks").count() == 0
    store.replace(*parts(spark, {i: (["a", "bb", "ccc"], 2) for i in range(8)}))
    store.replace(*parts(spark, {2: (["changed"], 2), 5: (["x", "y"], 3), 9: (["new"], 2)}))
    chunks, vectors = contents(store)
    assert {c for c in chunks if c[0] in (2, 5, 9)} == {(2, "2-0", "changed"), (5, "5-0", "x"), (5, "5-1", "y"), (9, "9-0", "new")}
    assert vectors == {c[:2] for c in chunks} and len(chunks) == 6 * 3 + 4
    assert {(r.dimensions, r.n) for r in store.stats("dimensions").collect()} == {(2, 20), (3, 2)}


def test_deleting_takes_all_tables(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    store.replace(*parts(spark, {i: (["a", "b"], 2) for i in range(5)}))
    store.delete(spark.createDataFrame([(1,), (77,)], "doc_id long"))
    store.delete_by_path("/in/3")
    for name in ("documents", "chunks", "vectors"):
        assert {r.doc_id for r in store.table(name).collect()} == {0, 2, 4}
    store.delete(spark.createDataFrame([(i,) for i in range(5)], "doc_id long"))
    assert [store.table(n).count() for n in ("documents", "chunks", "vectors")] == [0, 0, 0]
    store.replace(*parts(spark, {1: (["back"], 2)}))
    assert contents(store)[0] == {(1, "1-0", "back")}


def test_a_killed_job_changes_nothing_and_a_batch_counts_once(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    store.replace(*parts(spark, {1: (["old"], 2), 2: (["old"], 2)}), batch=("in", 0))
    d, c, v = parts(spark, {1: (["new"], 2)})
    broken = v.withColumn("embedding", F.when(F.raise_error(F.lit("killed")).isNull(), F.col("embedding")))
    with pytest.raises(Exception, match="killed"):
        store.replace(d, c, broken, batch=("in", 1))
    assert {x[2] for x in contents(store)[0]} == {"old"}
    assert store.replace(d, c, v, batch=("in", 1)) > 1
    before = store.manifest()
    assert store.replace(*parts(spark, {2: (["again"], 2)}), batch=("in", 1)) == before["version"] and store.manifest() == before
    assert {x[2] for x in contents(store)[0]} == {"new", "old"}
    store.vacuum()
    assert {x[2] for x in contents(store)[0]} == {"new", "old"}
    names = {n for t in ("chunks", "vectors") for n in store._names(t)}
    assert all(store._names(t, n) == [] or any(str(x) == n.split("=")[1] for x in store.manifest()["data"][t].values()) or store._names(t, n) == ["_SUCCESS"] for t in ("chunks", "vectors") for n in store._names(t)) and names


def test_search_joins_three_tables_and_reads_its_own_length(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    d, c, v = parts(spark, {1: (["a", "bbbbbb"], 2), 2: (["cc"], 2), 3: (["dd"], 4)})
    store.replace(d.withColumn("deleted_at", F.when(F.col("doc_id") == 2, F.lit("2024-01-01").cast("timestamp"))), c, v)
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, query array<double>")
    found = store.search(asked, 5)
    assert [(r.rank, r.chunk_id) for r in found.orderBy("rank").collect()] == [(1, "1-0"), (2, "1-1")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dimensions" in plan.split("PartitionFilters: [")[1].split("]")[0]
    both = asked.unionByName(spark.createDataFrame([(2, [2.0, 1.0, 0.0, 0.0])], "query_id long, query array<double>"))
    assert {(r.query_id, r.chunk_id) for r in store.search(both, 1, {"document_ids": [1, 3]}).collect()} == {(1, "1-0"), (2, "3-0")}


def test_a_stream_of_files_replaces_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)

    def tables(files):
        rows = files.select(F.regexp_extract("path", r"(\d+)-\d+\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("content"))
        chunks = rows.select("doc_id", F.posexplode(F.split("content", "\n"))).select("doc_id", F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), F.col("col").alias("content"))
        return rows.select("doc_id"), chunks, chunks.select("doc_id", "chunk_id", F.array(F.length("content").cast("double"), F.lit(1.0)).alias("embedding"))

    for name, text in (("1-1", "one\ntwo\nthree"), ("2-1", "other"), ("1-2", "short")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
        jobs.ingest_store(jobs.file_stream(spark, str(tmp_path / "in")), tables, store, str(tmp_path / "log")).awaitTermination()
    assert {c[2] for c in contents(store)[0]} == {"short", "other"}
