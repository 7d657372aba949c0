"""Consensus of several reviewers' labels by bipartite message passing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions.normalize import nfkc_strip
from shirabe.tables import Workspace

STATUSES = ("approved", "rejected", "uncertain")
#: Reviewer tables up to this many rows (about 150 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_REVIEWERS = 50_000


def latest_labels(history: DataFrame, classes: tuple[str, ...] = STATUSES) -> DataFrame:
    """(term_id, reviewer, label): the class number of each reviewer's latest status of a term.

    Usernames and statuses compare after NFKC, trim and lower case. The latest
    row is that of the greatest created_at, then review_version, then id (null
    is the smallest). A latest row whose status is no class, as ``unreviewed``,
    gives no label. Rows with a null term or reviewer are left out; rows
    delivered twice change nothing.
    """
    rows = history.select(
        "term_id",
        F.lower(nfkc_strip(F.col("reviewer_username"))).alias("reviewer"),
        F.struct("created_at", "review_version", "id", F.lower(nfkc_strip(F.col("new_status"))).alias("status")).alias("last"),
    ).where("term_id IS NOT NULL AND reviewer IS NOT NULL")
    last = rows.groupBy("term_id", "reviewer").agg(F.max("last").alias("last"))
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("last.status")) - 1
    return last.select("term_id", "reviewer", number.cast("int").alias("label")).where("label >= 0")


@dataclass
class Consensus:
    """terms: consensus, agreement and whether its beliefs came to rest; reviewers: reliability estimates; rounds: iterations used; converged: whether all came to rest."""

    terms: DataFrame
    reviewers: DataFrame
    rounds: int
    converged: bool


def _belief(score: Column) -> Column:
    """How likely a class is against the rest, from its log odds."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def consensus(labels: DataFrame, classes: tuple[str, ...] = STATUSES, right_count: float = 4.0, wrong_count: float = 1.0, tolerance: float = 5e-3, most_rounds: int = 60, damped_after: int = 15) -> Consensus:
    """Bipartite message passing over the label edges, one class against the rest.

    An edge joins a term and a reviewer and carries the label. For each class
    there is a problem of its own, with two answers: the label names the class or
    it does not. The message from the term says how likely the class is, by the
    other reviewers' messages; the message from the reviewer says how far this
    answer speaks for the class against the rest, given how often the reviewer
    names the class on all other terms where it holds and where it does not. Both
    leave out what came over the edge itself. Messages go back and forth until no
    belief moves by more than ``tolerance``. The consensus is the class whose odds
    against the rest are best.

    From round ``damped_after`` on a message moves half way only, which stops what
    would swing to and fro and leaves the point of rest as it is.
    A term's ``converged`` is false where a belief still moved by more in the last
    of ``most_rounds`` rounds. A round costs one aggregation by reviewer and one by
    term, both with map-side partial sums, so neither a busy reviewer nor a busy
    term gathers in one task; only the last round's edges are kept. No labels: both
    results are empty. A term with one label gets that label's most likely class.
    Ties go to the class named first. ``right_count`` and ``wrong_count`` are the
    labels that every reviewer is taken to have given rightly and to each wrong
    class beforehand.
    """
    spark = labels.sparkSession
    ws = Workspace(spark, "consensus")
    labels = labels.select("term_id", "reviewer", F.col("label").cast("int").alias("label"))
    k = range(len(classes))
    own = [(F.col("label") == c).cast("double") for c in k]
    whole = right_count + wrong_count * (len(classes) - 1)
    habit = (right_count / whole, wrong_count / whole, whole)
    degree = ws.write(labels.groupBy("term_id").agg(F.count("*").alias("degree"), *[F.sum(own[c]).alias(f"n{c}") for c in k]), "degree")
    first = [(F.col(f"n{c}") - own[c] + 1 / len(classes)) / F.col("degree") for c in k]
    edges = ws.write(labels.join(degree, "term_id").select("term_id", "reviewer", "label", "degree", *[first[c].alias(f"p{c}") for c in k]), "edges")
    few = edges.select("reviewer").distinct().count() <= BROADCAST_REVIEWERS
    prior, _ = _prior(edges.withColumn("change", F.lit(None).cast("double")), classes)
    rounds, change = 0, float("inf")
    while change > tolerance and rounds < most_rounds:
        rounds += 1
        spoken = _spoken(edges, classes, habit, few)
        moved = spoken.join(_heard(spoken, classes, prior), "term_id")
        heard = [_belief(F.col(f"t{c}") - F.col(f"w{c}")) for c in k]
        most = F.greatest(*[F.abs(heard[c] - F.col(f"p{c}")) for c in k])
        new = heard if rounds < damped_after else [(heard[c] + F.col(f"p{c}")) / 2 for c in k]
        before, edges = edges, ws.write(moved.select("term_id", "reviewer", "label", "degree", *[new[c].alias(f"p{c}") for c in k], most.alias("change")), "edges")
        ws.drop(before)
        prior, change = _prior(edges, classes)
    spoken = _spoken(edges, classes, habit, few)
    still = edges.groupBy("term_id").agg((F.max("change") <= tolerance).alias("converged"))
    judged = _heard(spoken, classes, prior).join(still, "term_id")
    best = F.greatest(*[F.col(f"t{c}") for c in k])
    status = F.coalesce(*[F.when(F.col(f"t{c}") == best, classes[c]) for c in k])
    pairs = sum([F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in k], F.lit(0.0))
    terms = judged.join(degree, "term_id").select(
        "term_id",
        status.alias("consensus_status"),
        _belief(best).alias("confidence"),
        F.col("degree").cast("int").alias("n_reviewers"),
        F.when(F.col("degree") > 1, pairs / (F.col("degree") * (F.col("degree") - 1))).alias("agreement"),
        "converged",
    )
    right = F.element_at(F.array(*[F.col(f"p{c}") for c in k]), F.col("label") + 1)
    reviewers = edges.groupBy("reviewer").agg(
        F.count("*").alias("n_labels"),
        F.avg(right).alias("reliability"),
        *[(F.sum(F.col(f"p{c}") * own[c]) / F.sum(f"p{c}")).alias(f"recall_{classes[c]}") for c in k],
    )
    return Consensus(terms, reviewers, rounds, change <= tolerance)


def _prior(edges: DataFrame, classes: tuple[str, ...]) -> tuple[list[float], float]:
    """Share of the terms that each class has, each term's edges weighing one together; and the greatest change of a belief."""
    row = edges.agg(*[F.sum(F.col(f"p{c}") / F.col("degree")) for c in range(len(classes))], F.sum(F.lit(1.0) / F.col("degree")), F.max("change")).first()
    *sums, whole, change = row
    return [min(max((x or 0.0) / whole, 1e-6), 1 - 1e-6) if whole else 1 / len(classes) for x in sums], change or 0.0


def _spoken(edges: DataFrame, classes: tuple[str, ...], habit: tuple[float, float, float], few: bool) -> DataFrame:
    """Edges with the reviewers' messages w: for each class the log of how much likelier the answer is where the class holds than where it does not."""
    k = range(len(classes))
    hit, slip, weight = habit
    names = [(F.col("label") == c) for c in k]
    held = edges.groupBy("reviewer").agg(
        F.count("*").cast("double").alias("m"),
        *[F.sum(f"p{c}").alias(f"h{c}") for c in k],
        *[F.sum(F.when(names[c], F.col(f"p{c}")).otherwise(0.0)).alias(f"hit{c}") for c in k],
        *[F.sum(names[c].cast("double")).alias(f"said{c}") for c in k],
    )
    joined = edges.join(F.broadcast(held) if few else held, "reviewer")

    def message(c: int) -> Column:
        mine, p = names[c].cast("double"), F.col(f"p{c}")
        where = (F.col(f"hit{c}") - mine * p + hit * weight) / (F.col(f"h{c}") - p + weight)
        elsewhere = (F.col(f"said{c}") - F.col(f"hit{c}") - mine * (1 - p) + slip * weight) / (F.col("m") - F.col(f"h{c}") - (1 - p) + weight)
        return F.when(names[c], F.log(where / elsewhere)).otherwise(F.log((1 - where) / (1 - elsewhere)))

    return joined.select("term_id", "reviewer", "label", "degree", *[f"p{c}" for c in k], *[message(c).alias(f"w{c}") for c in k])


def _heard(spoken: DataFrame, classes: tuple[str, ...], prior: list[float]) -> DataFrame:
    """(term_id, t...): the log odds of each class against the rest, beforehand and by all messages that reach the term."""
    return spoken.groupBy("term_id").agg(*[(F.sum(f"w{c}") + math.log(prior[c] / (1 - prior[c]))).alias(f"t{c}") for c in range(len(classes))])
