"""Whole jobs: one text in and one result out, and a run over many documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.operators import catalog, extract
from shirabe.plans import models
from shirabe.sources import sinks
from shirabe.tables import Workspace


def results(documents: DataFrame, files: DataFrame, threshold: float, mode: str = "demo") -> DataFrame:
    """(doc_id, json): the nested result of each document (doc_id, text); ``files`` has (doc_id, file_name)."""
    summary = extract.document_summary(extract.segment(documents), extract.extract(documents, threshold, examples=False))
    return sinks.result_json(extract.extract(documents, threshold, occurrences=True), summary, files, threshold, mode)


def extract_one(spark: SparkSession, payload: dict) -> dict:
    """The result for one payload (text, threshold, fileName, modelDir), as a program fed with JSON gives it.

    A text without sentences has a result with nothing in it. Without a usable
    model the mode is ``demo``.
    """
    threshold = float(payload.get("threshold", k.THRESHOLD_DEFAULT))
    mode = models.mode_of(payload.get("modelDir"))
    documents = spark.createDataFrame([(1, payload.get("text") or "", payload.get("fileName") or "document")], "doc_id bigint, text string, file_name string")
    found = results(documents, documents, threshold, mode).first()
    if found:
        return json.loads(found["json"])
    return {"mode": mode, "threshold": threshold, "sentenceCount": 0, "termCount": 0, "terms": [], "summary": {"highConfidence": 0, "mediumConfidence": 0, "reviewNeeded": 0}}


def extraction_run(documents: DataFrame, stored: DataFrame, threshold: float = k.THRESHOLD_DEFAULT) -> dict[str, DataFrame]:
    """The tables of an extraction over documents (doc_id, id, extraction_run_id, original_name, storage_key, text, status, error_message, size_bytes).

    runs: status and counts of the runs that are kept; refused: those without a
    readable document, of which nothing is stored; terms: the catalog's new rows;
    candidates and occurrences with the catalog's ids; aggregate: one row per term
    over all documents with its stored review status; response: the first
    occurrences of each term.
    """
    kept = documents.join(catalog.refused_runs(documents).select("extraction_run_id"), "extraction_run_id", "left_anti")
    sentences = extract.segment(kept)
    ws = Workspace(documents.sparkSession, "run")
    returned = ws.write(extract.top_terms(extract.extract(kept, threshold, occurrences=True)), "returned")
    files = kept.select("doc_id", F.col("original_name").alias("file_name"))
    ids = catalog.stored_terms(stored, returned)
    counts = sentences.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept.select("doc_id", "extraction_run_id"), "doc_id").groupBy("extraction_run_id").agg(F.sum("n").alias("sentence_count"))
    candidates = ws.write(catalog.run_candidates(returned, kept, ids), "candidates")
    found = candidates.groupBy("extraction_run_id").agg(F.count("*").alias("candidate_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    runs = catalog.run_status(kept).join(counts, "extraction_run_id", "left").join(found, "extraction_run_id", "left")
    return {
        "runs": runs.select("extraction_run_id", "status", "file_count", "failed_count", zero("sentence_count"), zero("candidate_count")),
        "refused": catalog.refused_runs(documents),
        "terms": catalog.new_terms(stored, returned),
        "candidates": candidates,
        "occurrences": catalog.run_occurrences(returned, kept, ids),
        "aggregate": catalog.with_review_status(extract.across_documents(returned, files, threshold, lists=True), stored),
        "response": extract.response_occurrences(returned, files, threshold),
    }
