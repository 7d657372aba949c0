"""Frequency of every distinct term value (vertical bitmap layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.functions.normalize import nfkc_strip


def run_ordinals(candidates: DataFrame) -> DataFrame:
    """(extraction_run_id, ordinal): a number for each run, dense within a partition.

    Runs are spread by hash and sorted inside each partition, so a task that is
    run again gives the same numbers. Neighbouring numbers share a bitmap word.
    """
    runs = candidates.select("extraction_run_id").where(F.col("extraction_run_id").isNotNull()).distinct()
    return runs.sortWithinPartitions("extraction_run_id").withColumn("ordinal", F.monotonically_increasing_id())


def term_frequencies(candidates: DataFrame, terms: DataFrame, rare_max: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term_value, total_frequency, n_runs, mark) for every distinct term value.

    Vertical layout: for each value a compressed bitmap of run ordinals, stored
    as its non-empty 64-bit words, with an occurrence counter beside each word.
    Words merge by bitwise union, counters by sum, both before the shuffle; the
    number of runs is the cardinality of the bitmap.

    Cases: rows with one id count once (if they differ, the least by run, term
    and frequency), rows without an id once each if they differ; a null frequency
    counts 1; a null run adds to the total but to no bitmap; a candidate without a
    known term is left out; terms with a null value have no row. A value without
    candidates has total 0 and no mark, as it never occurs. ``mark`` is ``rare``
    up to ``rare_max`` in total, else ``common`` above ``common_share`` of all
    runs, else null.
    """
    one = F.struct("extraction_run_id", "term_id", F.coalesce(F.col("frequency"), F.lit(1)).cast("long").alias("n"))
    rows = candidates.groupBy("id", F.when(F.col("id").isNull(), one).alias("nameless")).agg(F.min(one).alias("r")).select("r.*")
    ordinals = run_ordinals(candidates)
    values = terms.where("normalized_text IS NOT NULL").select(F.col("id").alias("term_id"), nfkc_strip(F.col("normalized_text")).alias("term_value"))
    words = (
        rows.join(ordinals, "extraction_run_id", "left")
        .groupBy("term_id", F.shiftright("ordinal", 6).alias("word"))
        .agg(F.bit_or(F.coalesce(F.expr("shiftleft(1L, cast(ordinal & 63 AS INT))"), F.lit(0).cast("long"))).alias("bits"), F.sum("n").alias("n"))
    )
    of_values = words.join(values, "term_id").select("term_value", "word", "bits", "n")
    without = values.select("term_value", F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"), F.lit(None).cast("long").alias("n"))
    merged = of_values.unionByName(without).groupBy("term_value", "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    counted = merged.groupBy("term_value").agg(F.sum("n").alias("sum"), F.sum(F.bit_count("bits")).cast("long").alias("n_runs"))
    runs = candidates.select("extraction_run_id").where(F.col("extraction_run_id").isNotNull()).distinct().agg(F.count("*").alias("n")).scalar()
    mark = F.when(F.col("sum") <= rare_max, "rare").when((F.col("sum") > rare_max) & (F.col("n_runs") > runs * common_share), "common")
    return counted.select("term_value", F.coalesce("sum", F.lit(0)).alias("total_frequency"), "n_runs", mark.alias("mark"))


def marked_terms(candidates: DataFrame, terms: DataFrame, rare_max: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term_value, mark) of the values that are too rare or too common."""
    return term_frequencies(candidates, terms, rare_max, common_share).where("mark IS NOT NULL").select("term_value", "mark")
