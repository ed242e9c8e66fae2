"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import chosen_path, decontaminate, fim_rank, phrase_pivot
from docquarry.llm.best_fit import pack_best_fit, token_pieces
from docquarry.llm.brown_lm import fit_brown, score_texts
from docquarry.llm.bucket_refine import remove_repeats
from docquarry.llm.decontaminate import contained_items
from docquarry.llm.dimension_scan import search_lists
from docquarry.llm.fim_rank import fill_in_middle, fim_digests
from docquarry.llm.line_crf import fit_quality, quality_result
from docquarry.llm.line_edit import dedup_lines
from docquarry.llm.phrase_pivot import collocations
from docquarry.llm.shared import staged
from docquarry.llm.token_prefix import prefix_token_counts, token_totals
from docquarry.llm.toxicity import fit_toxicity, toxicity_result
from docquarry.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_lists(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_result(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=0.8)


def op4_bucket_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_result(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op7_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = staged(prefix_token_counts(_table(spark, sf_dir, "documents"), budget=2048), "prefix-counts")
    return token_totals(tables, budget=2048)


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_classes(_table(spark, sf_dir, "documents")).drop("digest")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(token_pieces(_table(spark, sf_dir, "documents"), capacity=2048), capacity=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"), tau=2, min_bytes=20)
    return kept.select("doc_id", "n_lines", "n_repeated", "n_similar", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=10, covered=50, top=2000)


def op13_brown_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, fit_brown(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_dimension_scan": op1_dimension_scan,
        "op2_toxicity_cnn": op2_toxicity_cnn,
        "op3_containment": op3_containment,
        "op4_bucket_refine": op4_bucket_refine,
        "op5_warc_index": op5_warc_index,
        "op6_quality_crf": op6_quality_crf,
        "op7_token_prefix": op7_token_prefix,
        "op8_chosen_path": op8_chosen_path,
        "op9_best_fit": op9_best_fit,
        "op10_line_dedup": op10_line_dedup,
        "op11_rank_select": op11_rank_select,
        "op12_pivot_phrases": op12_pivot_phrases,
        "op13_brown_ngrams": op13_brown_ngrams,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_containment": decontaminate.ORACLE, "op5_warc_index": OP5_SQL, "op8_chosen_path": chosen_path.ORACLE, "op11_rank_select": fim_rank.ORACLE, "op12_pivot_phrases": phrase_pivot.ORACLE}
