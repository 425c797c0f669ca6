"""Document intake: whole text and DOCX files, guards, names, types, checksums; gold rows, manifests and reports.

PDF files are known and rejected: no library here reads them.
"""

from __future__ import annotations

import ast
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.session import ship

#: Suffixes of text files, and media types by suffix.
TEXT = ["txt", "md", "rst", "json", "yaml", "yml", "csv", "log", "py", "ts", "tsx", "js", "jsx"]
MEDIA = {
    "txt": "text/plain", "md": "text/markdown", "rst": "text/x-rst", "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml", "csv": "text/csv", "log": "text/plain", "py": "text/x-python", "ts": "text/x-typescript",
    "tsx": "text/x-typescript", "js": "text/javascript", "jsx": "text/javascript", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: Fixed value: an upload may have so many bytes.
MOST_BYTES = 25 << 20


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def media_type(name: Column) -> Column:
    return F.coalesce(*[F.when(suffix(name) == k, F.lit(v)) for k, v in MEDIA.items()])


def safe_name(name: Column) -> Column:
    """Runs of other signs become one underscore; none of ._ at the ends; never empty."""
    clean = F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_"), F.lit("._"))
    return F.when(clean == "", F.lit("document")).otherwise(clean)


def numbered_names(files: DataFrame, folder: str) -> DataFrame:
    """Files (folder, name, position): of equal names in a folder the second gets _1 before its suffix, the third _2, and so on."""
    again = F.row_number().over(W.partitionBy(folder, "name").orderBy("position")) - 1
    stem, end = F.regexp_extract("name", r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[A-Za-z0-9]+)?$", 2)
    return files.withColumn("again", again).withColumn("name", F.when(F.col("again") > 0, F.concat(stem, F.lit("_"), F.col("again"), end)).otherwise(F.col("name"))).drop("again")


def accepted(files: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a status), all columns as given: 413 for oversize files, 400 for types without a reader, 422 for empty ones."""
    status = F.when(F.col("length") > most, 413).when(media_type(F.col("name")).isNull(), 400).when(F.col("length") == 0, 422)
    marked = files.withColumn("status", status)
    return marked.filter("status IS NULL").drop("status"), marked.filter("status IS NOT NULL")


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, a line each; a broken file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    mark = {f"{space}t": lambda e: e.text or "", f"{space}tab": lambda e: "\t", f"{space}br": lambda e: "\n"}
    return "\n".join("".join(mark[e.tag](e) for e in p.iter() if e.tag in mark) for p in root.iter(f"{space}p"))


def _docx(content: Column) -> Column:
    ship()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            yield files.map(lambda c: docx_text(bytes(c)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(content)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, media_type, checksum, text) of text and DOCX files; bytes that are no UTF-8 are dropped, and so are files without a reader, oversize and empty ones."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", safe_name(F.element_at(F.split("path", "/"), -1)))
    kept, _ = accepted(files)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    rows = lambda df, body: df.select("name", "length", media_type(F.col("name")).alias("media_type"), F.sha2("content", 256).alias("checksum"), body.alias("text"))
    packed = suffix(F.col("name")) == "docx"
    return rows(kept.filter(~packed), text).unionByName(rows(kept.filter(packed), _docx(F.col("content"))))


def read_job(spark: SparkSession, path: str) -> DataFrame:
    """Job descriptions (name, text) among the files; those without any text don't count."""
    return read_texts(spark, path).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("name", "text")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header; a byte order mark before the first name is dropped, all columns are text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def with_manifest(gold: DataFrame, manifest: DataFrame, base: str) -> DataFrame:
    """Gold rows that have a resume_id, with ``file_path``: the manifest's local path, its source path, or the named file under ``base``; empty without any. Of repeated manifest rows any with a path counts."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    listed = manifest.filter(some(F.col("resume_id")).isNotNull()).groupBy("resume_id").agg(F.max(F.coalesce(some(F.col("local_pdf_path")), some(F.col("source_pdf_path")))).alias("listed"))
    named = F.concat(F.lit(base.rstrip("/") + "/sample_pdfs/"), some(F.col("local_pdf_name")))
    return gold.filter(some(F.col("resume_id")).isNotNull()).join(listed, "resume_id", "left").withColumn("file_path", F.coalesce("listed", named, F.lit(""))).drop("listed")


def jsonish(cell: Column) -> Column:
    """A cell's value as JSON text: cells hold JSON or a Python literal; null where neither can be read."""

    def one(text: str | None) -> str | None:
        for read in (json.loads, ast.literal_eval):
            try:
                return json.dumps(read(text.strip()), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, AttributeError, MemoryError, RecursionError):
                continue
        return None

    ship()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            yield cells.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(cell)


def save_report(report: DataFrame, folder: str, stamp: str, backend: str) -> str:
    """Writes the report's rows as JSON under a name of time and backend, and as the latest one; returns the first path."""
    path = f"{folder.rstrip('/')}/benchmark-{stamp}-{backend}.json"
    for target in (path, f"{folder.rstrip('/')}/latest.json"):
        report.withColumn("saved_report_path", F.lit(path)).write.mode("overwrite").json(target)
    return path


def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """The latest report's rows."""
    return spark.read.json(f"{folder.rstrip('/')}/latest.json")
