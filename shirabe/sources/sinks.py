"""Exports: CSV and JSON lines of the training rows and candidates, nested JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions import text as t
from shirabe.operators.catalog import training_order

# The columns of the exports, in their order.
TRAINING_COLUMNS = {
    "term": "term",
    "label": "label",
    "reviewStatus": "review_status",
    "context": "context",
    "fileName": "file_name",
    "page": "page",
    "extractionScore": "extraction_score",
    "reviewNote": "review_note",
    "reviewedByName": "reviewed_by_name",
    "reviewedAt": "reviewed_at",
    "termId": "term_id",
    "documentId": "document_id",
}
CANDIDATE_HEADER = ("Term", "Score", "Frequency", "Pages", "Files", "Group", "Source", "Evidence")


def _training_values() -> list[Column]:
    return [(t.iso_time(F.col(c)) if c == "reviewed_at" else F.col(c)).alias(name) for name, c in TRAINING_COLUMNS.items()]


def training_csv(rows: DataFrame) -> DataFrame:
    """Training rows with their CSV ``line``."""
    return rows.withColumn("line", t.csv_line(*_training_values()))


def training_json(rows: DataFrame) -> DataFrame:
    """Training rows with their JSON ``line``; nulls are kept."""
    return rows.withColumn("line", F.to_json(F.struct(*_training_values()), {"ignoreNullFields": "false"}))


def write_lines(lines: DataFrame, order: list[Column], path: str, separator: str = "\n", header: str | None = None) -> None:
    """Writes ``line`` in a total order as text parts, in the order of their names.

    Parts are sorted ranges, written side by side. The first begins with the
    header, if there is one; each line but a part's last ends with ``separator``.
    """
    ranged = lines.orderBy(*order)
    if header is not None:
        ranged = ranged.select("line", F.lit(1).alias("_n"))
        head = lines.sparkSession.createDataFrame([(header, 0)], "line string, _n int")
        ranged = head.unionByName(ranged)
    ranged.select("line").write.mode("overwrite").option("lineSep", separator).text(path)


def training_csv_header() -> str:
    """The header line with the byte-order mark that opens the file."""
    return "﻿" + ",".join(f'"{c}"' for c in TRAINING_COLUMNS)


def write_training_csv(rows: DataFrame, path: str) -> None:
    write_lines(training_csv(rows), training_order(), path, "\r\n", training_csv_header())


def write_training_json(rows: DataFrame, path: str) -> None:
    write_lines(training_json(rows), training_order(), path)


def candidate_csv(terms: DataFrame) -> DataFrame:
    """(term, line) of terms aggregated with ``lists``: score, frequency, all pages, all files, group label, source and evidence."""
    label = F.when(F.col("group") == "railway_dictionary_hint", "railwayHint").when(F.col("group") == "new_potential_term", "needsReview").otherwise("extractedResult")
    evidence = t.evidence_text(F.get("examples", F.lit(0)), F.col("first_file"))
    pages = F.when(F.size("pages") > 0, F.array_join("pages", ", ")).otherwise("-")
    return terms.select("term", t.csv_line(F.col("term"), F.col("score"), F.col("frequency"), pages, F.col("files"), label, F.col("source"), evidence).alias("line"))


def result_json(terms: DataFrame, summary: DataFrame, files: DataFrame, threshold: float, mode: str = "demo", key: str = "doc_id", limit: int = 300) -> DataFrame:
    """(key, json): each document's nested result; its counts cover all terms, its list the first ``limit``.

    ``terms`` have their ``occurrences``, all of which are written; sentence,
    sentence_id and span are those of the first. ``files`` has (key, file_name).
    """
    shown = terms.where(F.col("rank") <= limit)
    sentence = F.get("occurrences", F.lit(0))["sentence"].alias("sentence")
    span = (F.col("first_sentence_idx").alias("sentence_id"), "page", "pages", "start_char", "end_char", "source", "group", "examples", "occurrences")
    one = F.struct("rank", F.struct(F.col("rank").alias("id"), "term", F.col("term").alias("candidate"), "score", "frequency", sentence, *span).alias("t"))
    listed = shown.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("terms"))
    named = lambda x: x.withField("sentence_id", F.concat(F.coalesce("file_name", F.lit("document")), F.lit("_s"), x["sentence_id"].cast("string")))
    result = F.struct(
        F.lit(mode).alias("mode"),
        F.lit(threshold).alias("threshold"),
        F.col("sentence_count").alias("sentenceCount"),
        F.col("term_count").alias("termCount"),
        F.coalesce(F.transform("terms", named), F.array()).alias("terms"),
        F.struct(F.col("high").alias("highConfidence"), F.col("medium").alias("mediumConfidence"), F.col("review_needed").alias("reviewNeeded")).alias("summary"),
    )
    joined = summary.join(listed, key, "left").join(files.select(key, "file_name"), key, "left")
    return joined.select(key, F.to_json(result, {"ignoreNullFields": "false"}).alias("json"))
