import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shirabe.operators import review
from shirabe.operators.history import micros
from shirabe.streaming import jobs
from shirabe.tables import Workspace

EVENT = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string"
MINUTE = 60_000_000


def judged(spark, attempts):
    return {(r["key"], r["seq"]): (r["outcome"], r["failures"]) for r in attempts.collect()}


@pytest.fixture
def small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def events(seed, n=400):
    random.seed(seed)
    day = datetime(2024, 5, 1)
    return [(random.choice([1, 1, 1, 2, None]), i, day + timedelta(seconds=random.randint(0, 40_000)), random.choice(["error"] * 6 + ["signup", "view"])) for i in range(n)]


def plain(spark, rows):
    df = spark.createDataFrame(rows, EVENT).where(F.col("event_type").isin("error", "signup"))
    return review.attempt_outcomes(df.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("at_us"), (F.col("event_type") == "signup").alias("ok")), 15 * MINUTE)


def test_a_key_of_many_arrow_batches_is_judged_in_time_order(spark, tmp_path, small_arrow_batches):
    rows = events(3)
    spark.createDataFrame(rows, EVENT).repartition(5).write.parquet(str(tmp_path / "in"))
    got = jobs.stream_attempts(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema, Workspace(spark, "t-limit"), 15 * MINUTE)
    assert judged(spark, got) == judged(spark, plain(spark, rows))


def test_windows_stay_open_over_batches(spark, tmp_path, small_arrow_batches):
    rows = sorted(events(4), key=lambda r: r[2]) + [(3, 900, datetime(2024, 5, 1), "error")]
    for n, part in enumerate((rows[:150], rows[150:151], rows[151:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = jobs.stream_attempts(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema, Workspace(spark, "t-limit"), 15 * MINUTE, files_per_batch=1)
    assert judged(spark, got) == judged(spark, plain(spark, rows))


def test_ended_windows_are_forgotten(spark):
    judged_rows = spark.createDataFrame([(1, 5, 100 * MINUTE, "failed", 1, 100 * MINUTE), (2, 6, 101 * MINUTE, "ok", 0, None)], "key bigint, seq bigint, at_us bigint, outcome string, failures int, started bigint")
    before = spark.createDataFrame([(2, 3, 90 * MINUTE), (3, 2, 84 * MINUTE), (4, 2, 87 * MINUTE)], "key bigint, failures int, started bigint")
    keys = lambda **how: sorted(r["key"] for r in review.open_windows(judged_rows, before, **how).collect())
    assert keys() == [1, 3, 4] and keys(window_us=15 * MINUTE) == [1, 4] and keys(window_us=15 * MINUTE, late_us=2 * MINUTE) == [1, 3, 4]
