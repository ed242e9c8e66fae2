"""Documents to overlapping chunks, headings kept as context."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import estimated_tokens

SEPARATORS = ("\n\n", "\n", ".", ",", " ")
#: Texts that are held as Python strings at a time.
AT_ONCE = 200


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, section_no, heading, body``: a line of one to six # and a space starts a section.

    Heading lines are taken off; bodies lose trailing newlines and empty ones go,
    unless the text has no heading at all.
    """
    marks = F.split(F.regexp_replace(F.col(text_col), r"(?m)^(#{1,6}\s+)", "\u0001$1"), "\u0001")
    parts = docs.select(F.col(id_col), F.posexplode(marks).alias("section_no", "part"))
    headed = F.col("part").rlike(r"^#{1,6}\s")
    heading = F.when(headed, F.trim(F.regexp_replace(F.regexp_extract("part", r"^[^\n]*", 0), r"^#{1,6}\s+", "")))
    body = F.when(headed, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    return parts.select(id_col, "section_no", heading.alias("heading"), F.regexp_replace(body, r"\n+$", "").alias("body")).where("body <> ''")


def cut_points(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk. A chunk ends after the last separator, the strongest
    kind first, that leaves more than ``overlap`` characters; else at ``size``."""
    start, n = 0, len(text)
    while start < n:
        limit = start + size
        if limit >= n:
            yield start, n
            return
        end = limit
        for mark in SEPARATORS:
            at = text.rfind(mark, start, limit)
            if at - start > overlap:
                end = min(at + len(mark), limit)
                break
        yield start, end
        start = max(end - overlap, start + 1)


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """``id, chunk_index, char_start, char_end, content`` of each text.

    Where a chunk ends depends on where it began, so a text is walked in order
    inside its row; rows are spread by Spark. Only offsets come back from Python, where few texts are held at a time,
    and contents are cut only if they are read. Null and empty texts have no chunks.
    """

    @F.arrow_udf("array<struct<char_start int, char_end int>>")
    def cut(column: pa.Array) -> pa.Array:
        points, ends = array("i"), [0]
        for low in range(0, len(column), AT_ONCE):
            for text in column.slice(low, AT_ONCE).to_pylist():
                for point in cut_points(text or "", size, overlap):
                    points.extend(point)
                ends.append(len(points) // 2)
        pairs = np.frombuffer(points, np.int32).reshape(-1, 2) if points else np.zeros((0, 2), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], ["char_start", "char_end"]))

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.posexplode(cut(F.col(text_col))).alias("chunk_index", "_cut"))
    first, last = F.col("_cut.char_start"), F.col("_cut.char_end")
    return rows.select(id_col, "chunk_index", first.alias("char_start"), last.alias("char_end"), F.col("_text").substr(first + 1, last - first).alias("content"))


def chunk_sections(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of ``doc_id, text`` by section: offsets count within the section, contents
    carry ``[heading]``; indexes run through the document."""
    sections = split_sections(docs).withColumn("key", F.struct("doc_id", "section_no", "heading"))
    cut = chunk_texts(sections.select(F.to_json("key").alias("key"), "body"), "key", "body", size, overlap)
    kind = docs.schema["doc_id"].dataType.simpleString()
    open_key = F.from_json("key", f"doc_id {kind}, section_no int, heading string")
    rows = cut.withColumn("s", open_key).select("s.doc_id", "s.section_no", F.col("s.heading").alias("section"), F.col("chunk_index").alias("in_section"), "char_start", "char_end", "content")
    order = Window.partitionBy("doc_id").orderBy("section_no", "in_section")
    content = F.when(F.col("section").isNotNull(), F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.col("content"))).otherwise(F.col("content"))
    return rows.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("content", content).select("doc_id", "chunk_index", "section", "char_start", "char_end", "content")


def with_header(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the author, project and date of their document before the text, and a metadata map without nulls.

    ``docs``: doc_id, title, user_name, project, report_date, created_at, and user_id if the chunks are to keep their owner.
    """
    date = F.coalesce(F.col("report_date").cast("string"), F.date_format("created_at", "yyyy-MM-dd"))
    head = F.concat(F.lit("Report by: "), F.coalesce("user_name", F.lit("Unknown")), F.lit("\nProject: "), F.coalesce("project", F.lit("General")), F.lit("\nDate: "), date, F.lit("\n\n"))
    facts = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("user_name", "project", "report_date", "document_title", "chunk_index", "section")]),
        F.array(F.col("user_name"), F.col("project"), F.col("report_date").cast("string"), F.col("title"), F.col("chunk_index").cast("string"), F.col("section")),
    )
    owner = ["user_id"] if "user_id" in docs.columns else []
    joined = chunks.join(docs.select("doc_id", "title", "user_name", "project", "report_date", "created_at", *owner), "doc_id")
    full = F.concat(head, F.col("content"))
    return joined.select("doc_id", "chunk_index", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"), full.alias("content"), estimated_tokens(full).alias("token_count"), F.md5(full).alias("content_hash"), F.map_filter(facts, lambda _, v: v.isNotNull()).alias("metadata"), "char_start", "char_end", "user_name", "project", "report_date", "created_at", *owner)
