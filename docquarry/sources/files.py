"""Files to text: validation, dispatch by type, and duplicates by content."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import strip_markdown

MOST_BYTES = 50 * 1024 * 1024
#: Allowed extensions and the types they stand for.
TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, name, ext, mime, bytes, content`` of files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return raw.select("path", name.alias("name"), ext.alias("ext"), types[ext].alias("mime"), F.col("length").alias("bytes"), "content")


def content_type(content: Column) -> Column:
    """The type that the bytes themselves show: pdf, docx, zip (another archive), text, or binary.

    A DOCX is an archive that names ``word/document.xml`` among its members. Text has no zero byte in it and hardly
    other control characters, be it UTF-8 or Latin-1; UTF-16 shows by its mark.
    """
    start = F.hex(F.substring(content, 1, 5))
    named = lambda member: F.contains(content, F.lit(member.encode()))
    text = F.decode(content, "ISO-8859-1")
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]+", ""))
    return (
        F.when(start == "255044462D", "pdf")
        .when(start.startswith("504B0304"), F.when(named("word/document.xml"), "docx").otherwise("zip"))
        .when(start.rlike("^(FFFE|FEFF)"), "text")
        .when(F.contains(content, F.lit(b"\x00")) | (control * 100 > F.length(text)), "binary")
        .otherwise("text")
    )


def validate(files: DataFrame) -> DataFrame:
    """Adds ``found`` (the type by content) and ``problem``: null for a good file, else the first rule it breaks.

    The content must be of the kind that the extension says, and of the kind that the sender said, if there is a column ``declared`` (a
    MIME type; null or ``application/octet-stream`` says nothing).
    """
    family = F.when(F.col("ext").isin("pdf", "docx"), F.col("ext")).otherwise("text")
    said = F.col("declared") if "declared" in files.columns else F.lit(None).cast("string")
    sent = F.when(said == TYPES["pdf"], "pdf").when(said == TYPES["docx"], "docx").when(said.startswith("text/"), "text").when(said.isNull() | (said == "application/octet-stream"), F.col("found")).otherwise("other")
    return files.withColumn("found", content_type(F.col("content"))).withColumn(
        "problem",
        F.when(F.col("name").contains("..") | F.col("name").rlike(r"[/\\]"), "bad name")
        .when(F.col("bytes") == 0, "empty")
        .when(F.col("bytes") > MOST_BYTES, "too large")
        .when(F.col("mime").isNull(), "type not allowed")
        .when((F.col("ext") == "pdf") & (F.col("found") != "pdf"), "not a PDF")
        .when((F.col("ext") == "docx") & (F.col("found") != "docx"), "not a DOCX")
        .when(F.col("found") != family, F.concat(F.lit("content is "), F.col("found")))
        .when(F.col("found") != sent, "not what was declared"),
    )


def rejected(files: DataFrame) -> DataFrame:
    """``path, name, ext, declared, found, bytes, problem`` of validated files that break a rule: a table of their own."""
    said = F.col("declared") if "declared" in files.columns else F.lit(None).cast("string")
    return files.where("problem IS NOT NULL").select("path", "name", "ext", said.alias("declared"), "found", "bytes", "problem")


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1 (which every byte string is)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def _paragraph(node: ET.Element) -> str:
    out = []
    for part in node.iter():
        if part.tag == f"{_W}t":
            out.append(part.text or "")
        elif part.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif part.tag == f"{_W}tab":
            out.append("\t")
    level = node.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
    text = "".join(out)
    return "  " * int(level.get(f"{_W}val", "0")) + "- " + text if level is not None else text


def docx_text(raw: bytes) -> str:
    """Paragraphs, list items (two spaces a level and a dash) and table rows as ``| a | b |``."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    lines = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            lines.append(_paragraph(node))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [" ".join(_paragraph(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")]
                lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines).strip()


def extract_text(files: DataFrame, pdf_reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """``path, name, mime, text, error`` of valid files; plain, CSV and Markdown stay in the JVM.

    Markdown keeps its heading marks until it is chunked (strip_markdown takes
    them off). PDF needs ``pdf_reader``; without one its rows carry an error.
    """
    plain = files.where(~F.col("ext").isin("pdf", "docx")).select("path", "name", "mime", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for ext, content in zip(frame["ext"], frame["content"], strict=True):
                try:
                    if ext == "pdf" and pdf_reader is None:
                        raise ValueError("no PDF reader is set")
                    texts.append(docx_text(content) if ext == "docx" else pdf_reader(content))
                    errors.append(None)
                except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:  # one bad file is a row, not a failed job
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"path": frame["path"], "name": frame["name"], "mime": frame["mime"], "text": texts, "error": errors})

    packed = files.where(F.col("ext").isin("pdf", "docx")).select("path", "name", "ext", "mime", "content").mapInPandas(read, "path string, name string, mime string, text string, error string")
    tidy = F.regexp_replace(F.col("text"), "\n{3,}", "\n\n")
    return plain.unionByName(packed.withColumn("text", F.when(F.col("mime") == TYPES["pdf"], F.trim(tidy)).otherwise(F.col("text"))))


def new_content(files: DataFrame, known: DataFrame, content: str = "content", order: str = "path") -> DataFrame:
    """Files whose content hash is neither in ``known`` (column file_hash) nor earlier in the batch."""
    hashed = files.withColumn("file_hash", F.sha2(F.col(content), 256))
    first = Window.partitionBy("file_hash").orderBy(order)
    fresh = hashed.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def markdown_plain(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.when(F.col("mime") == TYPES["md"], strip_markdown(F.col("text"))).otherwise(F.col("text")))
