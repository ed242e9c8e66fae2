"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage calls one operator of ``docquarry.llm`` on all that its predecessor
kept; its result is written as Parquet to the shared folder and read again as the
next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import stages
from docquarry.llm.shared import staged_alone

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_jaccard_join", stages.keep_one_of_similar),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("best_fit_packing", stages.pack),
]

#: A trained model and its tokenizer decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
