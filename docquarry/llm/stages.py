"""Pipeline stages: each takes documents and gives documents, except the last.

Rows travel whole, as one struct, beside what a stage computes, so columns of any name
come out as they came in. Null texts count as empty, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.best_fit import pack_best_fit, token_pieces
from docquarry.llm.chosen_path import similar_classes
from docquarry.llm.decontaminate import contaminated_texts
from docquarry.llm.line_edit import dedup_lines
from docquarry.llm.shared import text_of
from docquarry.llm.shingles import clean_text
from docquarry.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. The model learns from the
    labelled rows of this stage's own input. Repeated rows are judged alike; null texts are kept or go as the empty text does."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_toxicity(docs.select(F.struct("*").alias("row"), text_of().alias("text"), lang.alias("lang")), model)
    return scored.where(~F.col("tox_rejected")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; ``n_chars`` follows the text. A null text becomes an empty one."""
    kept = dedup_lines(docs, tau=2, min_bytes=20, counts=False)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of similar documents.

    Rows that share that id (repeated rows, null ids) count as one document if their
    words are equal too: one of them stays. Of several texts of the least id, the one with the least digest stays.
    """
    classes = similar_classes(docs, 4, 5)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    one = kept.where("class_id IS NOT NULL").groupBy(F.col("class_id").alias("id")).agg(F.min("digest").alias("digest"))
    # null ids: a class of its own for each text, since none of them can name it
    nulls = kept.where("class_id IS NULL").select(F.col("doc_id").alias("id"), "digest").distinct()
    one = one.unionByName(nulls).select(F.col("id").alias("one_id"), F.col("digest").alias("one_digest"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(clean_text(text_of())).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("digest") == F.col("one_digest"))
    return marked.join(one, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to four fifths or more. Repeated rows are judged alike; ties
    between items do not matter, one is enough. Without items all documents stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_texts(docs, items, 0.8)
    rows = docs.select(F.struct("*").alias("row"), F.md5(text_of()).alias("digest"))
    return rows.join(found, "digest", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; a null or empty text is the one token that ends it.
    Repeated rows are packed each; only ``doc_id`` and ``text`` are read."""
    return pack_best_fit(token_pieces(docs, capacity=2048), capacity=2048)
