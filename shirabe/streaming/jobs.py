"""Structured Streaming forms of extraction and of the attempt limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shirabe.operators import extract, review
from shirabe.operators.history import micros
from shirabe.tables import Workspace


def stream_extract(spark: SparkSession, source: str, schema: StructType, workspace: Workspace, threshold: float) -> DataFrame:
    """Terms of the documents that arrive under ``source``, written batch by batch.

    Each micro-batch goes to a folder of its own number, so a batch that runs
    again after a failure replaces its own rows.
    """
    target = f"{workspace.root}/terms"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)

    def save(batch: DataFrame, number: int) -> None:
        extract.extract(batch, threshold).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{workspace.root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("batch")


def stream_attempts(spark: SparkSession, source: str, schema: StructType, workspace: Workspace, window_us: int, most: int = 5, files_per_batch: int | None = None, late_us: int = 3_600_000_000) -> DataFrame:
    """Outcomes of attempts, read from event files (user_id, event_id, ts, event_type).

    Each micro-batch is judged whole in the order of time, as
    ``review.attempt_outcomes`` does, from the windows that the batch before
    left open. Outcomes and open windows go to folders of the batch's number, so
    a batch that runs again after a failure replaces its own rows. Windows that
    ended more than ``late_us`` before the latest attempt are forgotten; an attempt
    that comes even later than that begins a new one.
    """
    target, windows = f"{workspace.root}/attempts", f"{workspace.root}/windows"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(source)
    attempts = events.where(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("at_us"), (F.col("event_type") == "signup").alias("ok"))

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{windows}/batch={number - 1}") if number else session.createDataFrame([], "key bigint, failures int, started bigint")
        review.judged_attempts(batch, before, window_us, most).write.mode("overwrite").parquet(f"{target}/batch={number}")
        judged = session.read.parquet(f"{target}/batch={number}")
        review.open_windows(judged, before, window_us, late_us).write.mode("overwrite").parquet(f"{windows}/batch={number}")

    attempts.writeStream.foreachBatch(save).option("checkpointLocation", f"{workspace.root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("key", "seq", "outcome", "failures")
