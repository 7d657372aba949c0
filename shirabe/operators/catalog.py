"""The term catalog: persistence, listings, evidence, history, summaries, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.functions import text as t
from shirabe.functions.normalize import nfkc, nfkc_strip


def new_terms(existing: DataFrame, extracted: DataFrame, order: str = "doc_id") -> DataFrame:
    """(normalized_text, term_text) of extracted terms the catalog lacks; existing rows stay as they are.

    Of several spellings of one value the first by ``order`` (ties: the smaller
    text) is taken. Values that normalize to nothing are left out.
    """
    seen = extracted.select(nfkc_strip(F.col("term")).alias("normalized_text"), "term", order).where("normalized_text <> ''")
    first = seen.groupBy("normalized_text").agg(F.min(F.struct(order, "term")).alias("f")).select("normalized_text", F.col("f.term").alias("term_text"))
    have = existing.select("normalized_text").where("normalized_text IS NOT NULL").distinct()
    return first.join(have, "normalized_text", "left_anti")


def stored_terms(existing: DataFrame, extracted: DataFrame, order: str = "doc_id") -> DataFrame:
    """(normalized_text, term_id) of the catalog once the extracted terms are in it; a new term's id is its own text after ``new:``."""
    fresh = new_terms(existing, extracted, order).select("normalized_text", F.concat(F.lit("new:"), "normalized_text").alias("term_id"))
    return existing.where("normalized_text IS NOT NULL").select("normalized_text", F.col("id").alias("term_id")).unionByName(fresh)


def _with_term_id(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of extracted terms with the id that the catalog has for their normalized text."""
    return rows.withColumn("normalized_text", nfkc_strip(F.col("term"))).join(stored, "normalized_text").drop("normalized_text")


def run_candidates(terms: DataFrame, documents: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, extraction_run_id, term_id, score, frequency, group, source): a run's candidate rows, one per term; ids are run and term."""
    rows = _with_term_id(terms, stored).join(documents.select("doc_id", "extraction_run_id"), "doc_id")
    grouped = rows.groupBy("extraction_run_id", "term_id").agg(
        F.max("score").alias("score"), F.sum("frequency").cast("int").alias("frequency"), F.max("group").alias("candidate_group"), F.max("source").alias("extraction_source")
    )
    return grouped.select(F.concat_ws("|", "extraction_run_id", "term_id").alias("id"), "*")


def run_occurrences(terms: DataFrame, documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Evidence rows of the runs: each of the returned terms' ``occurrences`` with its candidate's and its document's id, found by storage key.

    Documents without stored bytes and empty sentences are left out.
    """
    rows = _with_term_id(terms.select("doc_id", "term", "occurrences"), stored)
    docs = documents.where("storage_key IS NOT NULL").select("doc_id", "extraction_run_id", F.col("id").alias("document_id"))
    placed = rows.join(docs, "doc_id").select(F.concat_ws("|", "extraction_run_id", "term_id").alias("term_candidate_id"), "document_id", F.inline("occurrences")).where("sentence <> ''")
    return placed.select(
        "term_candidate_id",
        "document_id",
        F.col("page").alias("page_number"),
        F.col("sentence").alias("sentence_text"),
        F.col("startChar").alias("start_char"),
        F.col("endChar").alias("end_char"),
        "score",
    )


def stored_of(existing: DataFrame, texts: DataFrame) -> DataFrame:
    """The catalog's rows whose normalized text is among ``texts`` (normalized_text); no text is looked up twice, null ones match nothing."""
    return existing.join(texts.select("normalized_text").where("normalized_text IS NOT NULL").distinct(), "normalized_text", "left_semi").select(*existing.columns)


def without_runs(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """The tables after the runs (id) are deleted: their documents and candidates go with them, and the occurrences of either.

    Terms and their history stay. Null ids delete nothing.
    """
    gone = runs.select("id").where("id IS NOT NULL").distinct()
    left = dict(tables)
    drop = lambda name, column, ids: left[name].join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*left[name].columns)
    lost = lambda name, column: tables[name].join(gone.select(F.col("id").alias(column)), column, "left_semi").select("id").distinct()
    left["extraction_runs"] = drop("extraction_runs", "id", gone)
    left["documents"] = drop("documents", "extraction_run_id", gone)
    left["term_candidates"] = drop("term_candidates", "extraction_run_id", gone)
    left["term_occurrences"] = drop("term_occurrences", "document_id", lost("documents", "extraction_run_id"))
    left["term_occurrences"] = drop("term_occurrences", "term_candidate_id", lost("term_candidates", "extraction_run_id"))
    return left


def deletable_terms(terms: DataFrame, candidates: DataFrame, history: DataFrame) -> DataFrame:
    """(id) of the terms that neither a candidate nor a history row refers to: deleting any other is refused."""
    held = candidates.select("term_id").unionByName(history.select("term_id")).where("term_id IS NOT NULL").distinct()
    return terms.select("id").join(held.select(F.col("term_id").alias("id")), "id", "left_anti")


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON array of objects, by an explicit schema; missing fields are null."""
    return df.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def status_filter(status: str | None, column: str = "review_status") -> Column:
    """``reviewed`` means anything but ``unreviewed``; null or empty means no filter."""
    c = F.col(column)
    if status == "reviewed":
        return c != "unreviewed"
    return c == status if status else F.lit(True)


def client_filter(terms: DataFrame, stored: DataFrame, group: str = "all", status: str = "all", search: str = "") -> DataFrame:
    """Terms aggregated with ``lists`` (files joined by a blank) of a group and a stored review status, whose term or files hold ``search``.

    The search target is the term and all its files, NFKC in lower case.
    ``stored`` is the catalog; a term that it lacks is unreviewed.
    """
    import unicodedata

    text = unicodedata.normalize("NFKC", search).strip().lower()
    target = F.lower(nfkc(F.concat_ws(" ", "term", "files")))
    shown = terms.where(F.lit(group == "all") | (F.col("group") == group)).where(F.contains(target, F.lit(text)) if text else F.lit(True))
    if status == "all":
        return shown
    return with_review_status(shown, stored).where(F.col("review_status") == status).drop("review_status")


def with_review_status(terms: DataFrame, stored: DataFrame) -> DataFrame:
    """Extracted terms with the ``review_status`` that the catalog stores; a term that it lacks is unreviewed.

    The catalog grows with the data and is smaller in its files than in memory, so it must not look small enough to be broadcast.
    """
    reviewed = stored.groupBy(F.col("normalized_text").alias("_text")).agg(F.max_by("review_status", "review_version").alias("_status"))
    joined = terms.withColumn("_text", nfkc_strip(F.col("term"))).join(reviewed.hint("merge"), "_text", "left")
    return joined.withColumn("review_status", F.coalesce("_status", F.lit("unreviewed"))).drop("_text", "_status")


def next_unreviewed(terms: DataFrame, current: str) -> DataFrame:
    """The first other unreviewed term of ``with_review_status`` by score, frequency and term; no row if none is left."""
    rest = terms.where((F.col("term") != current) & (F.col("review_status") == "unreviewed"))
    return rest.orderBy(F.desc("score"), F.desc("frequency"), "term").limit(1)


def search_filter(search: str | None, columns: tuple[str, ...] = ("term_text", "normalized_text"), escape: bool = False) -> Column:
    """Substring in any letter case; the text is NFKC, trimmed and cut to 100 characters. Its % and _ are wildcards unless ``escape``."""
    import unicodedata

    text = unicodedata.normalize("NFKC", (search or "")[: k.SEARCH_MAX]).strip()
    if not text:
        return F.lit(True)
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(f"%{text}%")
    return found


def page_bounds(limit: object = None, offset: object = None) -> tuple[int, int]:
    """A page's limit (1 to 100, 50 by default) and offset (0 at least)."""
    number = lambda x, d: int(x) if str(x if x is not None else "").strip().lstrip("-").isdigit() else d
    return min(max(number(limit, 0) or k.PAGE_LIMIT_DEFAULT, 1), k.PAGE_LIMIT_MAX), max(number(offset, 0), 0)


def _candidates(candidates: DataFrame) -> DataFrame:
    """Candidates once each, with the default frequency."""
    return candidates.select("id", "extraction_run_id", "term_id", "score", F.coalesce("frequency", F.lit(1)).alias("frequency"), "candidate_group", "extraction_source", "created_at").distinct()


def term_stats(terms: DataFrame, candidates: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, frequency, document_count, score) of the given terms.

    Frequency and documents are counted in branches of their own, so a term's
    evidence does not multiply its frequency. Missing counts are 0, a missing
    score null. Rows delivered twice count once.
    """
    of = _candidates(candidates).join(terms.select(F.col("id").alias("term_id")), "term_id", "left_semi")
    sums = of.groupBy("term_id").agg(F.sum("frequency").cast("int").alias("frequency"), F.max("score").cast("double").alias("score"))
    pairs = occurrences.select("term_candidate_id", "document_id").join(of.select(F.col("id").alias("term_candidate_id"), "term_id"), "term_candidate_id").select("term_id", "document_id").distinct()
    docs = pairs.groupBy("term_id").agg(F.count("*").cast("int").alias("document_count"))
    joined = terms.select("id").join(sums, F.col("id") == sums["term_id"], "left").drop("term_id").join(docs, F.col("id") == docs["term_id"], "left")
    return joined.select("id", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("document_count", F.lit(0)).alias("document_count"), "score")


def list_terms(terms: DataFrame, candidates: DataFrame, occurrences: DataFrame, status: str | None = None, search: str | None = None, limit: object = None, offset: object = None) -> DataFrame:
    """A page of the catalog with usage figures.

    Filter, sort (latest review or creation first, then text, then id) and limit
    come before the figures, so these are made for the page's rows alone.
    ``filtered_count`` is the number of rows of the page, ``total`` that of all
    rows that match; ``position`` is the row's place in the listing.
    """
    size, skip = page_bounds(limit, offset)
    terms = terms.select("id", "term_text", "normalized_text", "review_status", "review_note", "reviewed_by_name", "reviewed_at", "review_version", "created_at")
    match = terms.where(status_filter(status)).where(search_filter(search))
    order = [F.desc("_at"), F.asc("term_text"), F.asc("id")]
    page = match.withColumn("_at", F.coalesce("reviewed_at", "created_at")).orderBy(*order).offset(skip).limit(size)
    page = page.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + skip).cast("int")).withColumn("filtered_count", F.count("*").over(Window.partitionBy()))
    page = page.withColumn("total", match.agg(F.count("*").alias("n")).scalar())
    stats = term_stats(page, candidates, occurrences)
    return page.join(stats, "id").select(
        "position",
        "id",
        F.col("term_text").alias("term"),
        "normalized_text",
        "review_status",
        "review_note",
        "reviewed_by_name",
        "reviewed_at",
        "review_version",
        "frequency",
        "document_count",
        "score",
        "filtered_count",
        "total",
    )


def page_range(total: int, limit: int, offset: int) -> tuple[int, int]:
    """The first and last row number that a page shows; 0 and 0 for an empty listing."""
    return (offset + 1 if total else 0), min(offset + limit, total)


def listing_range(terms: DataFrame, status: str | None = None, search: str | None = None, limit: object = None, offset: object = None) -> DataFrame:
    """(from_row, to_row, total): one row, what a page of ``list_terms`` shows of all rows that match."""
    size, skip = page_bounds(limit, offset)
    total = terms.where(status_filter(status)).where(search_filter(search)).agg(F.count("*").alias("total"))
    return total.select(F.when(F.col("total") > 0, F.lit(skip + 1)).otherwise(F.lit(0)).cast("long").alias("from_row"), F.least(F.lit(skip + size), F.col("total")).cast("long").alias("to_row"), "total")


def term_detail(terms: DataFrame, candidates: DataFrame, occurrences: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found, term, review_status, review_version, frequency, document_count, score) of each wanted id; unknown ids and what is no UUID are not found."""
    ids = wanted.select("id").distinct()
    rows = terms.join(ids.where(t.is_uuid(F.col("id"))), "id", "left_semi")
    stats = term_stats(rows, candidates, occurrences)
    known = rows.select("id", F.col("term_text").alias("term"), "review_status", "review_version").join(stats, "id").withColumn("_found", F.lit(True))
    return ids.join(known, "id", "left").select("id", F.coalesce("_found", F.lit(False)).alias("found"), "term", "review_status", "review_version", "frequency", "document_count", "score")


def term_evidence(candidates: DataFrame, occurrences: DataFrame, documents: DataFrame, runs: DataFrame, term_ids: DataFrame | None = None, limit: int = k.MAX_EVIDENCE) -> DataFrame:
    """Each term's evidence: latest run first, then file, page (none last), id; the first ``limit`` rows of a term.

    ``term_ids`` (id) limits it to these terms. The limit is applied to partial
    lists before they are gathered, so a term with very much evidence does not
    fill a task.
    """
    of = _candidates(candidates).select(F.col("id").alias("term_candidate_id"), "term_id", "extraction_run_id", "extraction_source")
    if term_ids is not None:
        of = of.join(term_ids.select(F.col("id").alias("term_id")), "term_id", "left_semi")
    rows = (
        occurrences.select("id", "term_candidate_id", "document_id", "page_number", "sentence_text", "start_char", "end_char", "score")
        .join(of, "term_candidate_id")
        .distinct()
        .join(documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("file_name")), "document_id")
        .join(runs.select(F.col("id").alias("extraction_run_id"), F.col("created_at").alias("run_at")), "extraction_run_id")
    )
    order = Window.partitionBy("term_id").orderBy(F.desc("run_at"), "file_name", F.asc_nulls_last("page_number"), "id")
    ranked = rows.withColumn("evidence_rank", F.row_number().over(order)).where(F.col("evidence_rank") <= limit)
    return ranked.select("term_id", "evidence_rank", "id", "document_id", "file_name", "page_number", "sentence_text", "start_char", "end_char", F.col("score").cast("double").alias("score"), "extraction_source", "run_at")


def review_history(history: DataFrame) -> DataFrame:
    """History rows once each, with their place in their term's listing, latest first."""
    order = Window.partitionBy("term_id").orderBy(F.desc("created_at"), F.desc("id"))
    columns = ["term_id", "id", "previous_status", "new_status", "note", "reviewer_name", "review_version", "created_at"]
    return history.select(*columns).distinct().withColumn("place", F.row_number().over(order)).select("term_id", "place", "id", "previous_status", "new_status", "note", "reviewer_name", "review_version", "created_at")


def review_summary(terms: DataFrame) -> DataFrame:
    """One row: all terms, terms of each status, and the reviewed ones together."""
    n = lambda s: F.count_if(F.col("review_status") == s).alias(s)
    counted = terms.agg(F.count("*").alias("total"), *[n(s) for s in k.STATUSES])
    return counted.withColumn("reviewed", F.col("approved") + F.col("rejected") + F.col("uncertain"))


def training_rows(terms: DataFrame, candidates: DataFrame, occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """Labelled evidence of approved and rejected terms; a term's rows spread over the tasks by its evidence."""
    judged = terms.where(F.col("review_status").isin("approved", "rejected"))
    label = F.when(F.col("review_status") == "approved", "positive").otherwise("negative")
    of = _candidates(candidates).select(F.col("id").alias("term_candidate_id"), F.col("term_id"))
    rows = judged.select(
        F.col("id").alias("term_id"), F.col("term_text").alias("term"), label.alias("label"), "review_status", "review_note", "reviewed_by_name", "reviewed_at"
    ).join(of, "term_id")
    evidence = occurrences.select(F.col("id").alias("occurrence_id"), "term_candidate_id", "document_id", F.col("page_number").alias("page"), F.col("sentence_text").alias("context"), F.col("score").cast("double").alias("extraction_score"))
    docs = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("file_name"))
    # Twins go after the join, which leaves only the judged terms' rows.
    return rows.join(evidence, "term_candidate_id").distinct().join(docs, "document_id").drop("term_candidate_id")


def training_order() -> list[Column]:
    """The order of the export; the last column makes it total."""
    return [F.asc("term"), F.asc("file_name"), F.asc_nulls_last("page"), F.asc("occurrence_id")]


def document_lookup(documents: DataFrame) -> DataFrame:
    """(id, file_name, mime_type, storage_key) of processed documents with stored bytes whose key stays inside the store."""
    inside = ~F.col("storage_key").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")
    return documents.where("status = 'processed' AND storage_key IS NOT NULL").where(inside).select("id", F.col("original_name").alias("file_name"), "mime_type", "storage_key")


def run_status(documents: DataFrame) -> DataFrame:
    """(extraction_run_id, status, file_count, failed_count, total_mb) by its documents: any error makes it completed_with_errors.

    A run of which no document could be read is not kept at all; see ``refused_runs``.
    """
    counted = _run_counts(documents).where("failed_count < file_count")
    status = F.when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed")
    return counted.select("extraction_run_id", status.alias("status"), "file_count", "failed_count", F.round(F.col("bytes") / 1048576, 2).alias("total_mb"))


def refused_runs(documents: DataFrame) -> DataFrame:
    """(extraction_run_id, file_count) of the runs of which no document could be read: the request fails and nothing is stored."""
    return _run_counts(documents).where("failed_count = file_count").select("extraction_run_id", "file_count")


def _run_counts(documents: DataFrame) -> DataFrame:
    failed = (F.col("status") == "failed") | F.col("error_message").isNotNull()
    return documents.groupBy("extraction_run_id").agg(F.count("*").alias("file_count"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed_count"), F.sum("size_bytes").alias("bytes"))


def admission(documents: DataFrame, max_files: int = k.UPLOAD_FILES, max_bytes: int = k.UPLOAD_BYTES) -> DataFrame:
    """(extraction_run_id, doc_id, error): whether each document of a run would be taken, and why not."""
    ext = t.extension(F.col("original_name"))
    known = ext.isin(*k.MIME_TYPES, "")
    place = F.row_number().over(Window.partitionBy("extraction_run_id", "_block").orderBy("doc_id"))
    # Whether there is text is settled first, so that no text is shuffled.
    blank = (F.coalesce(t.strip(F.col("text")), F.lit("")) == "").alias("_blank")
    blocks = documents.select("extraction_run_id", "doc_id", "original_name", "size_bytes", blank).withColumn("_block", F.floor(F.col("doc_id") / 4096))
    sizes = blocks.groupBy("extraction_run_id", "_block").agg(F.count("*").alias("n"))
    before = sizes.select("extraction_run_id", "_block", (F.sum("n").over(Window.partitionBy("extraction_run_id").orderBy("_block")) - F.col("n")).alias("before"))
    placed = blocks.withColumn("_place", place).join(before, ["extraction_run_id", "_block"]).withColumn("place", F.col("_place") + F.col("before"))
    error = (
        F.when(F.col("place") > max_files, "too_many_files")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(~known, "unknown_type")
        .when(F.col("_blank"), "no_text")
    )
    return placed.select("extraction_run_id", "doc_id", error.alias("error"))


def unique_files(files: DataFrame, keys: list[str], order: str, limit: int = k.UPLOAD_FILES) -> DataFrame:
    """Files once per key, the first by ``order``, at most ``limit`` of them in that order."""
    first = files.groupBy(*keys).agg(F.min(order).alias(order))
    return files.join(first, [*keys, order], "left_semi").orderBy(order).limit(limit)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n): how many rows, keys or references break each rule of the catalog's schema."""
    blank = lambda c: F.coalesce(t.strip(F.col(c)), F.lit("")) == ""
    outside = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("double").between(0, 1)
    checks: dict[str, dict[str, Column]] = {
        "extraction_runs": {"mode": ~F.col("mode").isin("demo", "bert"), "threshold": outside("threshold"), "status": ~F.col("status").isin("processing", "completed", "completed_with_errors", "failed")},
        "documents": {"status": ~F.col("status").isin("processed", "failed"), "stored": (F.col("status") == "processed") & (F.col("storage_key").isNull() | F.col("sha256").isNull())},
        "terms": {
            "status": ~F.col("review_status").isin(*k.STATUSES),
            "text": blank("term_text") | blank("normalized_text"),
            "version": F.col("review_version") < 0,
            "reviewer": (F.col("review_status") != "unreviewed") & (F.col("reviewed_by_username").isNull() | F.col("reviewed_at").isNull()),
        },
        "term_candidates": {"score": outside("score"), "frequency": F.col("frequency") <= 0},
        "term_occurrences": {"page": F.col("page_number") <= 0, "offsets": (F.col("start_char") < 0) | (F.col("end_char") < F.col("start_char")), "sentence": blank("sentence_text")},
        "term_review_history": {"previous": ~F.col("previous_status").isin(*k.STATUSES), "new": ~F.col("new_status").isin(*k.STATUSES), "version": F.col("review_version") <= 0},
    }
    keys = {"terms": [["id"], ["normalized_text"]], "documents": [["id"], ["storage_key"]], "extraction_runs": [["id"]], "term_candidates": [["id"], ["extraction_run_id", "term_id"]], "term_occurrences": [["id"]], "term_review_history": [["id"]]}
    references = [("documents", "extraction_run_id", "extraction_runs"), ("term_candidates", "extraction_run_id", "extraction_runs"), ("term_candidates", "term_id", "terms"), ("term_occurrences", "term_candidate_id", "term_candidates"), ("term_occurrences", "document_id", "documents"), ("term_review_history", "term_id", "terms")]
    parts: list[DataFrame] = []
    named = lambda df, table, rule: df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("n").cast("bigint").alias("n"))
    for table, rules in checks.items():
        counted = tables[table].agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(rule) for rule, bad in rules.items()])
        parts.append(counted.select(F.inline(F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(f"check_{rule}").alias("rule"), F.col(rule).alias("n")) for rule in rules]))))
    for table, sets in keys.items():
        for cols in sets:
            twice = tables[table].where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(*cols).agg(F.count("*").alias("c")).where("c > 1")
            parts.append(named(twice.agg(F.count("*").alias("n")), table, "unique_" + "_".join(cols)))
    for table, column, to in references:
        lost = tables[table].where(f"{column} IS NOT NULL").join(tables[to].select(F.col("id").alias(column)), column, "left_anti")
        parts.append(named(lost.agg(F.count("*").alias("n")), table, f"reference_{column}"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
