"""Ordered state machines per key: review decisions with version checks, and attempt limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.functions import text as t
from shirabe.operators.history import micros


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Callable[[object, tuple], tuple[object, tuple]], start: Callable[[tuple], object], columns: list[str], schema: str) -> DataFrame:
    """Runs ``step(state, row) -> (state, output)`` over each key's rows in order.

    Rows are spread by key, sorted inside each task and streamed, so a key's
    rows are never held together: memory stays the same however many it has.
    ``start(row)`` makes a key's first state from its first row. ``columns`` are
    read, the key first. The step must be a plain function.
    """
    spread = df.select(*columns, *[c for c in order if c not in columns]).repartition(key).sortWithinPartitions(key, *order)
    fields = [f.strip().rsplit(" ", 1)[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, begun = None, None, False
        for b in batches:
            rows = []
            for row in zip(*[b[c].astype(object).where(b[c].notna(), None) for c in columns]):
                if not begun or row[0] != last:
                    state, last, begun = start(row), row[0], True
                state, out = step(state, row)
                rows.append(out)
            yield pd.DataFrame(rows, columns=fields)

    return spread.mapInPandas(run, schema)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Review requests as they come in (status, note and version as text), with ``error``, the trimmed ``note`` and ``expected_version``.

    The first that fails is the error: ``status`` is none of the four, ``version``
    is no whole number from 0 on (null included), the trimmed ``note`` is longer than
    2,000 UTF-16 units. A null note is empty. Extra columns stay.
    """
    note = t.strip(F.coalesce(F.col("note"), F.lit("")))
    units = F.length("note") + F.length(F.regexp_replace("note", r"[^\x{10000}-\x{10FFFF}]", ""))
    number = F.col("version").try_cast("double")
    whole = F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False))
    error = F.when(~t.is_status(F.col("status")), "status").when(~whole, "version").when(units > k.NOTE_MAX, "note")
    return requests.withColumn("note", note).withColumn("error", error).withColumn("expected_version", F.when(whole, number.cast("int"))).drop("version")


def _review_start(row: tuple) -> tuple[int, str] | None:
    return None if row[1] is None else (int(row[1]), row[2])


def _review_step(state: tuple[int, str] | None, row: tuple) -> tuple[tuple[int, str] | None, tuple]:
    term, _, _, seq, status, note, expected, reviewer, at = row
    if state is None:
        return state, (term, seq, "not_found", None, None, None, None, None, at)
    version, now = state
    if expected is None or int(expected) != version:
        return state, (term, seq, "conflict", version, now, None, None, None, at)
    return (version + 1, status), (term, seq, "updated", version + 1, now, status, note or None, reviewer, at)


def review_outcomes(terms: DataFrame, requests: DataFrame) -> DataFrame:
    """The outcome of each review request, in the order of ``seq``, against the terms' stored versions.

    requests: (seq, term_id, status, note, expected_version, reviewer, at_us).
    A request is ``updated`` if it expects the version as it then stands, which
    it raises by one; else ``conflict``, and nothing changes. A term that the
    catalog lacks gives ``not_found``. ``version`` is the one after the request,
    ``status`` and ``previous_status`` are those of an update; an empty note is
    null. Requests without a term are left out.
    """
    now = terms.select(F.col("id").alias("term_id"), F.col("review_version").alias("stored_version"), F.col("review_status").alias("stored_status"))
    rows = requests.select("term_id", "seq", "status", "note", "expected_version", "reviewer", "at_us").where("term_id IS NOT NULL").join(now, "term_id", "left")
    return ordered_fold(
        rows,
        "term_id",
        ["seq"],
        _review_step,
        _review_start,
        ["term_id", "stored_version", "stored_status", "seq", "status", "note", "expected_version", "reviewer", "at_us"],
        "term_id string, seq bigint, kind string, version int, previous_status string, status string, note string, reviewer string, at_us bigint",
    )


def reviewed_terms(terms: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The terms after the updates: the last update's status, note, reviewer and time; back to unreviewed clears reviewer and time."""
    rest = ["version", "status", "note", "reviewer", "at_us"]
    last = outcomes.where("kind = 'updated'").groupBy("term_id").agg(F.max_by(F.struct(*rest), "version").alias("u"))
    cleared = F.col("u.status") == "unreviewed"
    take = lambda new, old: F.when(F.col("u").isNotNull(), new).otherwise(F.col(old))
    joined = terms.join(last, terms["id"] == last["term_id"], "left")
    return joined.select(
        "id",
        take(F.col("u.status"), "review_status").alias("review_status"),
        take(F.col("u.note"), "review_note").alias("review_note"),
        take(F.when(~cleared, F.col("u.reviewer")), "reviewed_by_username").alias("reviewed_by_username"),
        F.when(F.col("u").isNotNull(), F.when(~cleared, F.col("u.at_us"))).otherwise(micros(F.col("reviewed_at"))).alias("reviewed_at_us"),
        take(F.col("u.version"), "review_version").alias("review_version"),
        F.greatest(micros(F.col("updated_at")), F.col("u.at_us")).alias("updated_at_us"),
    )


def appended_history(outcomes: DataFrame) -> DataFrame:
    """The history rows that the updates append; a reset keeps the reviewer who made it."""
    return outcomes.where("kind = 'updated'").select("term_id", "previous_status", F.col("status").alias("new_status"), "note", F.col("reviewer").alias("reviewer_username"), F.col("version").alias("review_version"), F.col("at_us").alias("created_at_us"))


def _attempt(state: tuple[int, int] | None, at: int, ok: bool, window_us: int, most: int) -> tuple[tuple[int, int] | None, str, int]:
    """The window (failures, start) after an attempt, its outcome and the count."""
    if state and at - state[1] > window_us:
        state = None
    if state and state[0] >= most:
        return state, "blocked", state[0]
    if ok:
        return None, "ok", 0
    state = (state[0] + 1, state[1]) if state else (1, at)
    return state, "failed", state[0]


def attempt_outcomes(attempts: DataFrame, window_us: int = 15 * 60 * 1_000_000, most: int = 5) -> DataFrame:
    """(key, seq, outcome, failures) of attempts (key, seq, at_us, ok) in the order of (at_us, seq).

    A key's window starts with its first failure and ends when more than
    ``window_us`` have gone by. With ``most`` failures in it attempts are
    ``blocked`` and not counted; otherwise they are ``ok``, which clears the
    window, or ``failed``. ``failures`` is the count after the attempt.
    """

    def step(state: tuple[int, int] | None, row: tuple) -> tuple[tuple[int, int] | None, tuple]:
        key, seq, at, ok = row
        state, outcome, failures = _attempt(state, at, ok, window_us, most)
        return state, (key, seq, outcome, failures)

    kind = dict(attempts.dtypes)["key"]
    return ordered_fold(attempts, "key", ["at_us", "seq"], step, lambda row: None, ["key", "seq", "at_us", "ok"], f"key {kind}, seq bigint, outcome string, failures int")


def judged_attempts(attempts: DataFrame, windows: DataFrame, window_us: int, most: int) -> DataFrame:
    """``attempt_outcomes`` from ``windows`` (key, failures, started) on, with at_us and the start of the window after each attempt."""

    def step(state: tuple[int, int] | None, row: tuple) -> tuple[tuple[int, int] | None, tuple]:
        key, seq, at, ok, _, _ = row
        state, outcome, failures = _attempt(state, at, ok, window_us, most)
        return state, (key, seq, outcome, failures, at, state[1] if state else None)

    def start(row: tuple) -> tuple[int, int] | None:
        return None if row[4] is None else (int(row[4]), int(row[5]))

    kind = dict(attempts.dtypes)["key"]
    before = windows.toDF("_key", "_failures", "_started")
    rows = attempts.join(before, F.col("key").eqNullSafe(F.col("_key")), "left")
    return ordered_fold(rows, "key", ["at_us", "seq"], step, start, ["key", "seq", "at_us", "ok", "_failures", "_started"], f"key {kind}, seq bigint, outcome string, failures int, at_us bigint, started bigint")


def open_windows(judged: DataFrame, windows: DataFrame, window_us: int | None = None, late_us: int = 0) -> DataFrame:
    """(key, failures, started) after ``judged_attempts``: each key's last window, those of other keys as before.

    With ``window_us`` those are left out that ended more than ``late_us`` before
    the latest attempt: an attempt that comes no later than that begins a new one.
    """
    last = judged.groupBy("key").agg(F.max_by(F.struct("failures", "started"), F.struct("at_us", "seq")).alias("w"))
    changed = last.where("w.started IS NOT NULL").select("key", "w.failures", "w.started")
    same = F.col("key").eqNullSafe(F.col("_key"))
    whole = changed.unionByName(windows.join(last.select(F.col("key").alias("_key")), same, "left_anti").select("key", "failures", "started"))
    if window_us is None:
        return whole
    latest = judged.agg(F.max("at_us")).scalar()
    return whole.where(F.coalesce(F.col("started") + window_us + late_us >= latest, F.lit(True)))
