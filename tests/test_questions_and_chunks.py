import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.functions import questions as q
from docquarry.functions import text as t
from docquarry.operators import chunking

TODAY = "2026-05-20"  # a Wednesday


@pytest.mark.parametrize(
    "question,start,end",
    [
        ("reports of 2026-04-07", "2026-04-07", "2026-04-07"), ("in 2026-04 please", "2026-04-01", "2026-04-30"), ("2026-April", "2026-04-01", "2026-04-30"), ("april 15 notes", "2026-04-15", "2026-04-15"),
        ("Q2 2025", "2025-04-01", "2025-06-30"), ("Q32025", "2025-07-01", "2025-09-30"), ("March 2025", "2025-03-01", "2025-03-31"), ("the year 2024", "2024-01-01", "2024-12-31"),
        ("what happened today", "2026-05-20", "2026-05-20"), ("yesterday", "2026-05-19", "2026-05-19"), ("last night", "2026-05-19", "2026-05-19"), ("this week", "2026-05-18", "2026-05-24"), ("last week", "2026-05-11", "2026-05-17"),
        ("this month", "2026-05-01", "2026-05-31"), ("last month", "2026-04-01", "2026-04-30"), ("this year", "2026-01-01", "2026-12-31"), ("last year", "2025-01-01", "2025-12-31"),
        ("၂၀၂၆-၀၄", "2026-04-01", "2026-04-30"), ("၂၀၂၆ ခုနှစ် ဧပြီလ", "2026-04-01", "2026-04-30"), ("မနေ့က ရာသီဥတု", "2026-05-19", "2026-05-19"), ("2026-02-31", "2026-02-01", "2026-02-28"), ("nothing here", None, None),
    ],
)
def test_dates(spark, question, start, end):
    row = spark.createDataFrame([(question,)], "question string").select(q.date_range(F.col("question"), F.lit(TODAY).cast("date")).alias("d")).first()
    want = None if start is None else (datetime.date.fromisoformat(start), datetime.date.fromisoformat(end))
    assert (row.d and (row.d["from"], row.d["to"])) == want


def test_classes_scores_and_terms(spark):
    rows = [("Compare Q3 and Q4 revenue", "comparative"), ("Explain why revenue fell", "analytical"), ("Who filed the report?", "factual"), ("Tell me about the documents", "generic")]
    frame = spark.createDataFrame(rows, "question string, want string").select("*", q.classify(F.col("question")).alias("type"), q.search_terms(F.col("question")).alias("terms"), q.complexity(F.col("question")).alias("score"))
    got = frame.collect()
    assert all(r.type == r.want for r in got)
    assert got[0].terms == ["Compare", "and", "revenue"] and got[2].terms == ["filed", "the", "report"] and got[1].score == 1
    other = spark.createDataFrame([("  in 2026-04 and 2026-04-07 ",)], "x string").select(q.normalise(F.col("x")).alias("n"), q.boolean_query(F.lit("Orion 2026 alpha မဟုတ် beta")).alias("b")).first()
    assert other.n == "in 2026-April and 2026-04-07" and other.b == "Orion & !alpha & beta"


@pytest.mark.parametrize("text,size,overlap,n,some", [("Hello world", 1000, 200, 1, [(0, 11)]), ("A paragraph of text. " * 200, 200, 50, 29, [(0, 188), (138, 335), (285, 482), (432, 629)]), ("Paragraph one.\n\nParagraph two.\n\nParagraph three. " + "word " * 100, 50, 0, 13, [(0, 32), (32, 48), (48, 94), (94, 144)])])
def test_cuts(text, size, overlap, n, some):
    got = list(chunking.cut_points(text, size, overlap))
    assert len(got) == n and got[: len(some)] == some and got[-1][1] == len(text)
    assert all(b <= c[1] and c[0] <= b for (_, b), c in zip(got, got[1:], strict=False))


def test_sections_and_headers(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody one\n\n## Two words\nbody two\n", "T", "Ann", None, None, None), (2, "", "E", None, None, None, None), (3, None, "N", None, None, None, None)], "doc_id long, text string, title string, user_name string, project string, report_date date, created_at timestamp")
    cut = chunking.chunk_sections(docs)
    assert [(r.chunk_index, r.section, r.content) for r in cut.orderBy("chunk_index").collect()] == [(0, None, "intro"), (1, "One", "[One]\nbody one"), (2, "Two words", "[Two words]\nbody two")]
    dated = docs.withColumn("report_date", F.lit("2024-05-06").cast("date"))
    full = chunking.with_header(cut, dated).orderBy("chunk_index").collect()
    assert full[1].content == "Report by: Ann\nProject: General\nDate: 2024-05-06\n\n[One]\nbody one" and "project" not in full[1].metadata and full[1].metadata["section"] == "One"


def test_text(spark):
    row = spark.createDataFrame([("# A\n![i](u) **b** [c](d) `e` ~f~",)], "x string").select(t.strip_markdown(F.col("x")).alias("m"), t.estimated_tokens(F.lit("abcde")).alias("n")).first()
    assert row.m == "A\n b c e f" and row.n == 2 and t.like_pattern("5%_") == "%5\\%\\_%"
