import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docquarry.llm import shared, stages
from docquarry.llm.shared import join_hot, staged
from tests.llm.helpers import make_docs, words


CLASHING = ["_key", "_id", "_d", "_digest", "_thash", "tox_score", "tox_rejected", "n_lines", "n_removed", "row", "digest", "hot_fact", "cls", "tag"]


def tables(spark, tmp_path):
    import random

    rng = random.Random(6)
    docs = make_docs(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars", "key")
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        rows.append((1000 + k, words(rng, 30, 300) + (" vile awful" if toxic else ""), "en", None, 0, "k"))
        labels.append((1000 + k, 1, int(toxic)))
    item = words(rng, 25)
    rows += [(5000, words(rng, 40) + " " + item + " " + words(rng, 30), "en", None, 0, "k")]
    folder = str(tmp_path)
    clashing = {c: F.lit(k) for k, c in enumerate(CLASHING)}
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns(clashing).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_turn(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    after = [staged(docs, "documents")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after.append(staged(stage(spark, after[-1], folder), name))
        assert after[-1].columns == columns
        assert [tuple(r) for r in after[-1].select(*CLASHING).distinct().collect()] == [tuple(range(len(CLASHING)))]
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in after]
    toxic = {1000 + k for k in range(0, 400, 4)}
    assert len(toxic - ids[1]) > 95 and len({1000 + k for k in range(400)} - toxic - ids[1]) < 5
    assert ids[2] == ids[1] and after[2].count() == after[1].count()
    assert {2, 30} & ids[3] == {2} and {3, 31} & ids[3] == {3} and after[3].where("doc_id = 7").count() == 1
    assert 5000 in ids[3] and ids[3] - ids[4] == {5000}
    last = corpus_pipeline.STAGES[-1][1](spark, after[4], folder)
    assert Counter(r.doc_id for r in last.where("piece = 0").collect()) == Counter(r.doc_id for r in after[4].collect())
    whole = corpus_pipeline.run(spark, folder)
    place = lambda d: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert place(whole) == place(last)


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k % 2, k) for k in range(300)] + [(99, 0, -1)], "a long, b int, x long")
    facts = rows.where("a <> 99").groupBy("a", "b").agg(F.struct(F.count("*").alias("n")).alias("fact"))
    want = Counter((r.a, r.b, r.x, None if r.fact is None else r.fact.n) for r in rows.join(facts, ["a", "b"], "left").collect())
    for most in (0, 100):
        got = join_hot(rows, facts, ["a", "b"], F.col("fact.n") > 30, most)
        assert Counter((r.a, r.b, r.x, None if r.fact is None else r.fact.n) for r in got.collect()) == want


def test_stages_leave_only_the_tables_that_their_result_reads(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = set(shared._staged)
        out = stage(spark, docs, folder)
        left = {path.rsplit("/", 1)[1].split("-", 2)[2] for _, path in set(shared._staged) - before}
        read = {f.rsplit("/", 2)[1].split("-", 2)[2] for f in out.inputFiles() if "docquarry-" in f.rsplit("/", 2)[1]}
        assert left == read and out.count() > 0, name


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.drop_toxic, stages.drop_repeated_lines, stages.keep_one_of_similar, stages.drop_contaminated, stages.pack]


def test_toxic_texts_go_by_what_all_labelled_rows_say(spark, tmp_path):
    """Words of toxic texts that a sample of 3000 labelled rows would not hold."""
    rng = random.Random(9)
    n = 9000
    docs = spark.createDataFrame([(i, words(rng, 6, 50), "en") for i in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(1500) for y in (0, 1)]
    sampled = {r.doc_id for some in first for r in some.collect()}
    vile = [i for i in range(n) if i % 2 and i not in sampled]
    marked = docs.withColumn("text", F.when((F.col("doc_id") % 2 == 1) & ~F.col("doc_id").isin(list(sampled)), F.concat("text", F.lit(" VILE!! VILE!!"))).otherwise(F.col("text"))).localCheckpoint()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in stages.drop_toxic(spark, marked, str(tmp_path)).select("doc_id").collect()}
    assert not kept & set(vile) and len(kept) > 4000
