import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.operators import cache
from docquarry.operators.queue import BACKOFF, due_jobs, job_states, job_stream
from docquarry.streaming.changes import AnswerState, expirations

LOG = "doc_id long, at timestamp, event string"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def log_of(spark, rows):
    return spark.createDataFrame([(d, at(s), e) for d, s, e in rows], LOG)


FLOWS = {
    1: [(0, "queued"), (1, "started"), (2, "done")],
    2: [(0, "queued"), (1, "started"), (2, "failed"), (10, "started"), (40, "started"), (41, "failed"), (400, "started"), (401, "failed"), (9000, "started")],
    3: [(0, "queued"), (5, "queued"), (6, "done"), (7, "started")],
    4: [(0, "queued"), (1, "started"), (2, "failed"), (3, "queued"), (4, "started")],
    5: [(0, "started"), (1, "done")],
    6: [(0, "queued"), (1, "started"), (2, "done"), (3, "queued"), (4, "started")],
    7: [(0, "queued"), (1, "started"), (2, "failed")],
}


def test_states_follow_the_rules(spark):
    rows = [(d, s, e) for d, flow in FLOWS.items() for s, e in flow]
    got = {r.doc_id: (r.status, r.attempts, r.due) for r in job_states(log_of(spark, rows)).collect()}
    assert got == {
        1: ("completed", 1, None), 2: ("failed", 3, None), 3: ("processing", 1, None), 4: ("processing", 1, None),
        5: ("none", 0, None), 6: ("completed", 1, None), 7: ("failed", 1, at(2 + BACKOFF[0])),
    }
    states = job_states(log_of(spark, rows))
    assert {r.doc_id for r in due_jobs(states, F.lit(at(31))).collect()} == set() and {r.doc_id for r in due_jobs(states, F.lit(at(32))).collect()} == {7}
    assert job_states(log_of(spark, [])).count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    parts = [[(d, s, e) for d, flow in FLOWS.items() for s, e in flow if low <= s < high] for low, high in ((0, 3), (3, 100), (100, 20000))]
    out = str(tmp_path / "out")
    for k, rows in enumerate([*parts, [(99, 40000, "queued")], [(99, 40001, "started")]]):
        log_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={k}"))
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        job_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    last = {}
    for r in rows:
        if not r.retry and (r.doc_id not in last or r.at > last[r.doc_id].at):
            last[r.doc_id] = r
    want = {r.doc_id: (r.status, r.attempts, r.due) for r in job_states(log_of(spark, [x for p in parts for x in p])).collect()}
    assert {d: (r.status, r.attempts, r.due) for d, r in last.items() if d != 99} == want
    assert {r.doc_id for r in rows if r.retry} >= {7}


def test_expirations_agree(spark, tmp_path):
    touches = spark.createDataFrame([("a", at(0)), ("a", at(50)), ("a", at(500)), ("b", at(10)), ("c", at(5000))], "user string, ts timestamp")
    batch = {(r.user, r.expired_at, r.touches) for r in expirations(touches, "100 seconds", "user").collect()}
    assert batch == {("a", at(150), 2), ("a", at(600), 1), ("b", at(110), 1), ("c", at(5100), 1)}
    touches.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    expirations(stream, "100 seconds", "user", late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.user, r.expired_at, r.touches) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {x for x in batch if x[1] <= at(5000)}


def test_changes_count_versions_and_drop_answers(spark, tmp_path):
    state = AnswerState(spark, str(tmp_path / "state"))
    assert state.global_version() == 1 and state.versions().count() == 0 and state.entries() is None
    kinds = "entry_id long, query_vector array<double>, user_id string, model_hash string, version int, doc_ids array<string>"
    now = F.lit("2024-01-02").cast("timestamp")
    state.put(spark.createDataFrame([(1, [1.0], "u", "m", 1, ["A"]), (2, [1.0], "u", "m", 1, ["B"]), (3, [1.0], "v", "m", 1, [])], kinds), now)
    folder = tmp_path / "in"
    for k, ids in enumerate((["A", "A", "C"], ["C"])):
        spark.createDataFrame([(i,) for i in ids], "doc_id string").coalesce(1).write.parquet(str(folder / f"n={k}"))
        state.listen(spark.readStream.schema("doc_id string").option("recursiveFileLookup", "true").parquet(str(folder)), str(tmp_path / "log")).awaitTermination()
    assert {(r.doc_id, r.version) for r in state.versions().collect()} == {("A", 3), ("C", 3)}
    assert {r.entry_id for r in state.entries().collect()} == {2, 3} and state.global_version() == 1
    log = spark.createDataFrame([(i,) for i in ("A", "A", "C", "C")], "doc_id string")
    assert {(r.doc_id, r.version) for r in cache.document_versions(log).collect()} == {(r.doc_id, r.version) for r in state.versions().collect()}
    state.change(spark.createDataFrame([("B",)], "doc_id string"), batch=0)  # an old batch
    assert state.entries().count() == 2
    state.change(spark.createDataFrame([(None,), (None,)], "doc_id string"), batch=7)
    assert state.entries().count() == 0 and state.global_version() == 2


@pytest.mark.parametrize("retention", ["embeddings", "answers", "sessions"])
def test_retentions_are_durations(spark, retention):
    from docquarry.streaming.changes import RETENTION

    row = spark.createDataFrame([("a", at(0))], "user string, ts timestamp")
    days = {"embeddings": 1, "answers": 7, "sessions": 30}[retention]
    assert expirations(row, RETENTION[retention], "user").first().expired_at == at(days * 86400)
