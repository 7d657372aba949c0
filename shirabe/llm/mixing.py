"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.tables import Workspace

DEFAULT_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
_ENCODER: list = [None, None]


def _tokenizer_file(path: str | None) -> tuple[bytes, str]:
    """The rank file's bytes (about 1 MB) and the splitting pattern."""
    import public_tokenizers

    return open(path or public_tokenizers.path(DEFAULT_TOKENIZER), "rb").read(), public_tokenizers.PATTERN


def _encoder(shared):
    """The tokenizer of a broadcast rank file, made once per Python worker."""
    if _ENCODER[0] is not shared.value:
        import tiktoken

        data, pattern = shared.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODER[:] = shared.value, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER[1]


def token_counts(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): sources after trim and lower case; documents without text or source are left out."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(_tokenizer_file(tokenizer_path))
    source = F.lower(F.trim("source"))
    docs = documents.select("doc_id", source.alias("source"), "text").where("text IS NOT NULL AND text <> '' AND source IS NOT NULL AND source <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(encode(t)) for t in b["text"]]})

    return docs.mapInPandas(run, "doc_id bigint, source string, tokens bigint")


@dataclass
class Mix:
    """records: (doc_id, source, repeat, tokens, finish) in the order of the mix; shares: the report by source."""

    records: DataFrame
    shares: DataFrame
    budget: float


def mix(sizes: DataFrame, weights: DataFrame, budget: float | None = None, seed: int = 7, bucket_rows: int = 50_000) -> Mix:
    """Mixes documents (doc_id, source, tokens) to the targets (source, target_share, max_repeats).

    Weighted fair queueing: the documents of a source are shuffled by a keyed
    hash; a document's virtual finish time is the source's tokens up to and with
    it, over the source's weight; repeats of a source follow on from its first
    use. The mix is all records in the order of finish time, truncated where the
    time passes the budget, at which every source has given its share of it.

    Without a ``budget`` it is the largest one at which no source is needed more
    than ``max_repeats`` times over; with one, a source that would be needed more
    often stops there. Shares are taken over the sources that have documents, as
    ``normalized_share`` says; others are reported with nothing. A source not among the weights, or with a
    share of 0 or null, gives nothing; max_repeats of null or under 1 counts as 1.

    The running sum goes over hash buckets of about ``bucket_rows`` documents,
    then inside each, so no source gathers in a task. Only one row per source of
    ``weights`` reaches the driver.
    """
    named = weights.select(F.lower(F.trim("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).where("source IS NOT NULL")
    wanted = named.where("target_share > 0").groupBy("source").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    ws = Workspace(sizes.sparkSession, "mix")
    sizes = ws.write(sizes.select("doc_id", "source", "tokens").where("tokens > 0").join(wanted.select("source"), "source", "left_semi"), "sizes")
    totals = {r["source"]: (r["n"], r["total"]) for r in sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("total")).collect()}
    rules = {r["source"]: (r["weight"], r["max_repeats"]) for r in wanted.collect()}
    there = {s: rules[s] for s in totals}
    scale = sum(w for w, _ in there.values()) or 1.0
    limits = {s: reps * totals[s][1] / (w / scale) for s, (w, reps) in there.items()}
    time = float(budget) if budget is not None else min(limits.values(), default=0.0)
    plan = [(s, w / scale, totals[s][1], max(1, min(reps, -(-time * (w / scale) // totals[s][1])))) for s, (w, reps) in there.items()]
    spark = sizes.sparkSession
    sources = spark.createDataFrame([(s, w, t, int(k)) for s, w, t, k in plan], "source string, weight double, total bigint, uses int")
    buckets = max(16, -(-sum(n for n, _ in totals.values()) // bucket_rows))
    placed = sizes.withColumn("at", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(buckets)))
    before = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("inside", inside).join(before, ["source", "bucket"]).join(F.broadcast(sources), "source")
    repeated = summed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    finish = ((F.col("repeat") - 1) * F.col("total") + F.col("before") + F.col("inside")) / F.col("weight")
    taken = repeated.select("doc_id", "source", "repeat", "tokens", finish.alias("finish")).where(F.col("finish") <= time * (1 + 1e-12))
    used = taken.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.max("repeat").alias("repeats"))
    every = Window.partitionBy()
    named = named.join(sources.select("source", "weight", F.lit(True).alias("used")), "source", "left")
    shares = named.join(used, "source", "left").select(
        "source",
        "target_share",
        F.coalesce(F.when(F.col("used").isNotNull(), F.col("weight")), F.lit(0.0)).alias("normalized_share"),
        "max_repeats",
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.coalesce(F.col("tokens") / F.sum("tokens").over(every), F.lit(0.0)).alias("actual_share"),
    )
    return Mix(taken.orderBy("finish", "source", "doc_id"), shares, time)
