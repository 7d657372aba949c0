"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm import consensus as c
from shirabe.llm import dedup, leaks, mixing, pii, sentences
from shirabe.llm import terms as t
from shirabe.tables import Workspace, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return t.marked_terms(load(spark, d, "term_candidates"), load(spark, d, "terms"))


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return t.term_frequencies(load(spark, d, "term_candidates"), load(spark, d, "terms"))


def _consensus(spark: SparkSession, d: str) -> c.Consensus:
    return c.consensus(c.latest_labels(load(spark, d, "term_review_history")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).terms.where("n_reviewers >= 3").select("term_id", "consensus_status")


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).terms


def p2_reviewers(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).reviewers


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.found_pairs(load(spark, d, "documents"), load(spark, d, "extraction_runs"), Workspace(spark, "p3"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "documents"), load(spark, d, "term_occurrences"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.cleaned(load(spark, d, "documents"), load(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(mixing.token_counts(load(spark, d, "documents")), load(spark, d, "source_weights"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).records


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p7_shares_of_budget(spark: SparkSession, d: str) -> DataFrame:
    """The shares at a budget of twice all tokens, where small sources come to the end of their repeats."""
    counts = mixing.token_counts(load(spark, d, "documents"))
    counts = Workspace(spark, "p7").write(counts, "counts")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    return mixing.mix(counts, load(spark, d, "source_weights"), 2.0 * total).shares


#: For the demonstration only; a real run takes its key from outside.
DEMO_KEY = b"demonstration key"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.person_spans(load(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(load(spark, d, "documents"), DEMO_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_frequencies, p2_found, p2_agreement, p2_reviewers, p3_found, p5_found, p6_found, p6_leaks, p6_cleaned, p7_mix, p7_shares, p7_shares_of_budget, p8_found, p8_redacted)}
