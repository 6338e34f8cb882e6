"""Reading a vault: Markdown files, images, PDFs, archives and JSON lists, as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import udfs

FRONT_MATTER = r"(?dsm)^---\n(.*?)\n---[ \t]*(?:\n|\z)"


def _decoded(content: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ("utf-8-sig", "gbk"):
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "replace")

    return content.map(one)


#: Text of a file: UTF-8 with or without a mark, else GBK, else with replacement characters.
decoded = F.pandas_udf(_decoded, T.StringType())


def parts_of(path: Column, root: str) -> Column:
    """Path below the vault's folder, in parts: ``a/b`` sorts before ``a-b`` only so."""
    below = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    return F.split(F.regexp_replace(below, "^.*?" + _quoted(root.rstrip("/")) + "/", ""), "/")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def markdown_notes(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, path_parts, stem, mtime, fm, body): every note of the folder. ``fm`` is the first front matter block as JSON,
    empty where it is broken; ``body`` what follows it, or the whole text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).load(root)
    rows = files.select("path", parts_of(F.col("path"), root).alias("path_parts"), F.col("modificationTime").alias("mtime"), F.regexp_replace(decoded("content"), "\r\n?", "\n").alias("text"))
    block = F.regexp_extract("text", FRONT_MATTER, 1)
    has = F.col("text").rlike(FRONT_MATTER)
    body = F.when(has, F.regexp_replace("text", r"(?dsm)\A.*?" + FRONT_MATTER, "")).otherwise(F.col("text"))
    name = F.element_at("path_parts", -1)
    return rows.select("path", "path_parts", F.regexp_replace(name, r"\.md$", "").alias("stem"), "mtime", udfs.front_matter_json(F.when(has, block).otherwise("")).alias("fm"), body.alias("body"))


def file_names(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(dir, name, mtime, length) of files; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_replace("path", "^.*/", "").alias("name"), F.col("modificationTime").alias("mtime"), "length")


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text): whole text files; missing or broken ones are left out."""
    rows = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_values(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): JSON files as VARIANT; null for a broken one."""
    return texts(spark, root, "*.json").select("path", F.try_parse_json("text").alias("value"))


def zip_members(spark: SparkSession, root: str) -> DataFrame:
    """(path, member, ord, kind, content) of the files in archives: the Markdown text, images and the list of contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for i, member in enumerate(archive.infolist()):
                    name = member.filename
                    kind = "text" if name.endswith("full.md") else "contents" if name.endswith("content_list_v2.json") else "image" if "images/" in name and not name.endswith("/") else None
                    if kind:
                        rows.append((path, name, i, kind, archive.read(member)))
            yield pd.DataFrame(rows, columns=["path", "member", "ord", "kind", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInPandas(run, "path string, member string, ord int, kind string, content binary")


def _pdf_reader() -> Callable[[bytes], list[str]]:
    """Page texts of a PDF by whichever library is installed."""
    try:
        import fitz

        return lambda data: [page.get_text() for page in fitz.open(stream=data, filetype="pdf")]
    except ImportError:
        pass
    try:
        import pdfplumber

        return lambda data: [page.extract_text() or "" for page in pdfplumber.open(io.BytesIO(data)).pages]
    except ImportError:
        raise RuntimeError("no library that reads PDFs is installed: give a reader, or start from a table of pages") from None


def pdf_pages(spark: SparkSession, root: str, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page, text) of the PDFs of a folder, pages from 0. ``reader`` makes page texts of a file's bytes; a file that it
    cannot read has no rows. A file is read whole by one task."""
    read = reader or _pdf_reader()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = read(content)
                except Exception:  # whatever a library raises for a broken file
                    continue
                rows += [(path, i, text) for i, text in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table kept as Parquet; empty if it is not there yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
