"""Documents from files: text, DOCX, page-marked text; per-file errors instead of failing jobs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.functions import text as t

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file's body, each followed by an empty line; tabs and breaks are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for paragraph in body.iter(f"{_W}p"):
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                out.append(node.text or "")
            elif node.tag == f"{_W}tab":
                out.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        out.append("\n\n")
    return "".join(out)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, extension, mime_type, sha256, size_bytes, text, error) of the files under ``path``.

    Text files are UTF-8, bad bytes replaced; DOCX files give their body's text.
    Other types, broken files and files without text have an error and no text.
    The hash is of the raw bytes. PDF has no reader here: its pages come in as a
    table, see ``page_marked``.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", t.mojibake_repaired(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).alias("file_name"), F.col("length").alias("size_bytes"), "content")
    files = files.withColumn("extension", t.extension(F.col("file_name"))).withColumn("sha256", F.sha2("content", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for ext, content in zip(b["extension"], b["content"]):
                text, error = None, None
                try:
                    if ext in k.TEXT_EXTENSIONS:
                        text = bytes(content).decode("utf-8", "replace")
                    elif ext == ".docx":
                        text = docx_text(bytes(content))
                    else:
                        error = "unknown_type"
                except Exception as e:  # a file's fault is data, not a failed job
                    error = f"unreadable: {type(e).__name__}"
                if error is None and not (text or "").strip():
                    text, error = None, "no_text"
                texts.append(text)
                errors.append(error)
            yield b.drop(columns=["content"]).assign(text=texts, error=errors)

    read = files.mapInPandas(run, "path string, file_name string, size_bytes bigint, extension string, sha256 string, text string, error string")
    return read.withColumn("mime_type", t.mime_type(F.col("extension")))


def page_marked(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): documents of pages (key, page, text), each page after its marker line; null page texts are empty."""
    line = F.concat(F.lit("[[PAGE "), F.col("page").cast("string"), F.lit("]]\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))), lambda p: p["line"]), "\n").alias("text"))


def limited(files: DataFrame, max_files: int = k.UPLOAD_FILES, max_bytes: int = k.UPLOAD_BYTES) -> DataFrame:
    """Files with ``admitted``: the first ``max_files`` by path that are not too large."""
    place = F.row_number().over(Window.orderBy("path"))
    fits = files.where(F.col("size_bytes") <= max_bytes).select("path").orderBy("path").limit(max_files).withColumn("place", place)
    return files.join(fits, "path", "left").withColumn("admitted", F.col("place").isNotNull()).drop("place")
