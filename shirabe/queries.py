"""The core queries, by name. Each takes a session and a data folder and reads whole tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.functions import text as t
from shirabe.operators import catalog, extract, history, names, review
from shirabe.plans import jobs as plan_jobs
from shirabe.plans import models
from shirabe.sources import files, sinks
from shirabe.streaming import jobs
from shirabe.tables import Workspace, load

#: With the pattern generator few terms reach the default threshold; this one shows all of them.
THRESHOLD = 0.5
#: Literal candidates with the awkward forms of the cleaning rules.
RAW_CANDIDATES = ("(12) 信号機", "第3章信号", "700系", "2-3番線", "ＡＴＳ", "すべて", "・踏切・", "架 線", "1.軌道", "A", "ー", "第１２節 分岐器", "[ホーム]", "a" * 41, "-制御", "12")

#: Kanji beside katakana.
SCRIPT_CHUNK = "[一-龥々〆ヵヶ]+[ァ-ヴー]+|[ァ-ヴー]+[一-龥々〆ヵヶ]+"

#: A literal text with more terms than a document returns.
LONG_TEXT = "。".join(f"線{chr(0x4E00 + 7 * i)}区{chr(0x4E00 + 11 * i)}" for i in range(350)) + "。信号機。信号機"


def _terms(spark: SparkSession, d: str, examples: bool = False) -> DataFrame:
    return extract.extract(load(spark, d, "documents"), THRESHOLD, examples=examples)


def _named(spark: SparkSession, d: str, examples: bool = False, occurrences: bool = False) -> DataFrame:
    """The terms that each document's extraction returns, with the name of its file."""
    docs = load(spark, d, "documents").withColumnRenamed("original_name", "file_name")
    return extract.top_terms(extract.extract(docs, THRESHOLD, examples=examples, occurrences=occurrences, carried=("file_name",)))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return extract.candidates(extract.segment(load(spark, d, "documents")))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("original_name").alias("file_name"))


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return extract.segment(load(spark, d, "documents"))


def candidate_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "sentence_idx", "start_char", "end_char", "term", "source")


def extract_terms_by_doc(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query."""
    return _terms(spark, d).select("doc_id", "rank", "term", "frequency", "raw_frequency", "score", "group", "source", "page", "first_sentence_idx", "start_char", "end_char")


def top_terms_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return extract.top_terms(_terms(spark, d)).select("doc_id", "rank", "term")


def term_examples_pages(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d, True).select("doc_id", "term", _joined("pages"), _joined("examples"))


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return extract.document_summary(extract.segment(docs), extract.extract(docs, THRESHOLD, examples=False))


def result_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return extract.totals(extract.segment(docs).groupBy("doc_id").agg(F.count("*").alias("sentence_count")), docs, THRESHOLD)


def aggregate_across_docs(spark: SparkSession, d: str) -> DataFrame:
    out = extract.across_documents(_named(spark, d, True), None, THRESHOLD)
    return out.withColumn("examples", F.array_join("examples", "|"))


def pages_by_file(spark: SparkSession, d: str) -> DataFrame:
    return extract.pages_by_file(_named(spark, d)).withColumn("pages", F.array_join("pages", "|"))


def clean_and_validate(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(x,) for x in RAW_CANDIDATES], "raw string")
    raw = load(spark, d, "terms").select(F.col("term_text").alias("raw")).unionByName(given).distinct()
    cleaned = raw.select("raw", t.clean_candidate(t.normalize_text(F.col("raw"))).alias("cleaned"))
    return cleaned.withColumn("valid", t.valid_candidate(F.col("cleaned")))


def heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    used = load(spark, d, "term_candidates").select("id", "term_id", F.coalesce("frequency", F.lit(1)).alias("frequency")).distinct()
    rows = used.join(load(spark, d, "terms").select(F.col("id").alias("term_id"), F.col("normalized_text").alias("term")), "term_id")
    return rows.select("id", t.heuristic_score(F.col("term"), F.col("frequency")).alias("score"), t.group_tag(F.col("term")).alias("group"))


def overlap_resolution(spark: SparkSession, d: str) -> DataFrame:
    spans = load(spark, d, "term_occurrences").select("document_id", "sentence_text", "start_char", "end_char", F.col("score").cast("double").alias("score"), (F.length("sentence_text") % 3 + F.col("start_char") % 2).alias("raw_frequency")).distinct()
    return extract.resolve_overlaps(spans, ["document_id", "sentence_text"])


def _returned(spark: SparkSession, d: str) -> DataFrame:
    """The terms that each document's extraction returns."""
    return extract.top_terms(_terms(spark, d))


def top_terms_of_long_text(spark: SparkSession, d: str) -> DataFrame:
    """The limit of a document's terms over a literal text that has more of them."""
    docs = spark.createDataFrame([(1, LONG_TEXT), (2, LONG_TEXT[:200])], "doc_id bigint, text string")
    return extract.top_terms(extract.extract(docs, THRESHOLD)).select("doc_id", "rank", "term", "frequency", "score")


def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    return catalog.new_terms(load(spark, d, "terms"), _returned(spark, d))


def _persisted(spark: SparkSession, d: str, occurrences: bool = False) -> tuple[DataFrame, DataFrame]:
    returned = extract.top_terms(extract.extract(load(spark, d, "documents"), THRESHOLD, examples=False, occurrences=occurrences))
    columns = ["doc_id", "term", "frequency", "score", "source", "group", *["occurrences"] * occurrences]
    returned = Workspace(spark, "persist").write(returned.select(*columns))
    return returned, catalog.stored_terms(load(spark, d, "terms"), returned)


def persist_candidates(spark: SparkSession, d: str) -> DataFrame:
    returned, stored = _persisted(spark, d)
    return catalog.run_candidates(returned, load(spark, d, "documents"), stored)


def persist_occurrences(spark: SparkSession, d: str) -> DataFrame:
    returned, stored = _persisted(spark, d, True)
    return catalog.run_occurrences(returned, load(spark, d, "documents"), stored)


def json_recordset(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "term_review_history").distinct().groupBy("term_id", "review_version").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "new_status")))).alias("payload"))
    return catalog.recordset(rows, "payload", "id:bigint,new_status:string")


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.violations({n: load(spark, d, n) for n in ("extraction_runs", "documents", "terms", "term_candidates", "term_occurrences", "term_review_history")})


def _listing(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return catalog.list_terms(*[load(spark, d, n) for n in ("terms", "term_candidates", "term_occurrences")], **how)


def list_terms_page(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d)


def list_terms_search(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d, search="ｋ2", limit=100)


def list_terms_reviewed(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d, status="reviewed", limit="500", offset=20)


def term_usage(spark: SparkSession, d: str) -> DataFrame:
    return catalog.term_stats(*[load(spark, d, n) for n in ("terms", "term_candidates", "term_occurrences")])


def listing_range(spark: SparkSession, d: str) -> DataFrame:
    """What the second page of 50 shows."""
    return catalog.listing_range(load(spark, d, "terms"), status="reviewed", offset=50)


def term_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every term by its id, and ids that are unknown or no UUIDs."""
    other = spark.createDataFrame([("00000000-0000-4000-8000-000000000000",), ("x",)], "id string")
    return catalog.term_detail(*[load(spark, d, n) for n in ("terms", "term_candidates", "term_occurrences")], load(spark, d, "terms").select("id").unionByName(other))


def status_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """What the client shows of a term's review, and its address."""
    terms = load(spark, d, "terms")
    return terms.select("id", t.status_label(F.col("review_status")).alias("label"), t.local_date_time(F.col("reviewed_at")).alias("reviewed"), t.uri_component(F.col("term_text")).alias("address"))


def term_evidence(spark: SparkSession, d: str) -> DataFrame:
    return catalog.term_evidence(*[load(spark, d, n) for n in ("term_candidates", "term_occurrences", "documents", "extraction_runs")])


def review_history(spark: SparkSession, d: str) -> DataFrame:
    return catalog.review_history(load(spark, d, "term_review_history"))


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.review_summary(load(spark, d, "terms"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each history row as a request that expects the version before its own, in the order of their ids."""
    status = F.lower(F.trim("new_status"))
    rows = load(spark, d, "term_review_history").distinct()
    return rows.select(F.col("id").alias("seq"), "term_id", status.alias("status"), "note", (F.col("review_version") - 1).alias("expected_version"), F.col("reviewer_username").alias("reviewer"), history.micros(F.col("created_at")).alias("at_us"))


def _unreviewed(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as it was before any review."""
    empty = {"review_version": F.lit(0), "review_status": F.lit("unreviewed"), "review_note": F.lit(None).cast("string"), "reviewed_by_username": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp_ntz")}
    return load(spark, d, "terms").withColumns(empty | {"updated_at": F.col("created_at")})


def checked_requests(spark: SparkSession, d: str) -> DataFrame:
    """The history's rows as raw requests: statuses as written, versions from below 0, notes drawn out past the limit."""
    rows = load(spark, d, "term_review_history").distinct()
    raw = rows.select("id", "term_id", F.col("new_status").alias("status"), F.repeat(F.concat(F.coalesce("note", F.lit(" 注 ")), F.lit(" ")), F.lit(90)).alias("note"), (F.col("review_version") - 2).cast("string").alias("version"))
    return review.checked_requests(raw).select("id", "term_id", "status", "note", "expected_version", "error")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return review.review_outcomes(_unreviewed(spark, d), _requests(spark, d))


def apply_reviews_cas(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("term_id", "seq", "kind", "version", "previous_status", "status")


def reviewed_terms(spark: SparkSession, d: str) -> DataFrame:
    return review.reviewed_terms(_unreviewed(spark, d), _outcomes(spark, d)).select("id", "review_status", "review_note", "reviewed_by_username", "review_version")


def appended_history(spark: SparkSession, d: str) -> DataFrame:
    return review.appended_history(_outcomes(spark, d))


def login_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").where(F.col("event_type").isin("error", "signup"))
    attempts = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), history.micros(F.col("ts")).alias("at_us"), (F.col("event_type") == "signup").alias("ok"))
    return review.attempt_outcomes(attempts, window_us=2 * 86_400 * 1_000_000)


def _training(spark: SparkSession, d: str) -> DataFrame:
    return catalog.training_rows(*[load(spark, d, n) for n in ("terms", "term_candidates", "term_occurrences", "documents")])


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return _training(spark, d).drop("reviewed_at")


def training_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.training_csv(_training(spark, d)).select("occurrence_id", "line")


def training_jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.training_json(_training(spark, d)).select("occurrence_id", "line")


def candidate_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.candidate_csv(_aggregate(spark, d, evidence=True))


def _aggregate(spark: SparkSession, d: str, separator: str = "; ", evidence: bool = False) -> DataFrame:
    return extract.across_documents(_named(spark, d, evidence), None, THRESHOLD, lists=True, separator=separator, evidence=evidence)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate without evidence and lists."""
    return extract.across_documents(_named(spark, d), None, THRESHOLD, evidence=False)


def client_view(spark: SparkSession, d: str) -> DataFrame:
    shown = catalog.client_filter(_aggregate(spark, d, " "), load(spark, d, "terms"), group=k.NEW_GROUP, search="形")
    return shown.select("term", "frequency", t.percent(F.col("score")).alias("percent"), t.score_band(F.col("score")).alias("band"), t.short_name(F.col("first_file")).alias("file"), t.source_key("first_file", "first_page").alias("source_key"))


def client_view_of_file(spark: SparkSession, d: str) -> DataFrame:
    """A search that only file names can match, of terms with one review status."""
    shown = catalog.client_filter(_aggregate(spark, d, " "), load(spark, d, "terms"), status="unreviewed", search="ＰＤＦ")
    return shown.select("term", "frequency", "n_files")


def client_orders(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each term of the aggregate, and its places in the client's other two orders."""
    terms = Workspace(spark, "orders").write(_aggregate(spark, d).select("term", "score", "frequency", "first_file", "first_page"))
    for order, name in ((extract.aggregate_order(), "rank"), (extract.frequency_order(), "by_frequency"), (extract.source_order(), "by_source")):
        terms = extract.ranked(terms, order, name)
    return terms.select("term", "rank", "by_frequency", "by_source")


def aggregate_totals(spark: SparkSession, d: str) -> DataFrame:
    return extract.aggregate_summary(_counts(spark, d))


def terms_with_review(spark: SparkSession, d: str) -> DataFrame:
    """Extracted terms with the review status that the catalog stores."""
    return catalog.with_review_status(_counts(spark, d).select("term", "frequency"), load(spark, d, "terms"))


def next_unreviewed(spark: SparkSession, d: str) -> DataFrame:
    terms = catalog.with_review_status(_counts(spark, d), load(spark, d, "terms"))
    return catalog.next_unreviewed(terms, "信号").select("term", "score", "frequency")


def response_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """The first occurrences of each term in a response, one row each."""
    listed = extract.response_occurrences(_named(spark, d, occurrences=True), None, THRESHOLD)
    rows = listed.select("term", F.posexplode("occurrences").alias("place", "o"))
    return rows.select("term", "place", F.col("o.documentId").alias("doc_id"), F.col("o.fileName").alias("file_name"), F.col("o.sentence").alias("sentence"), F.col("o.page").alias("page"), F.col("o.startChar").alias("start_char"), F.col("o.endChar").alias("end_char"), F.col("o.score").alias("score"))


def fuzzy_file_match(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(t.file_key(F.col("original_name")).alias("outer"))
    return names.contained_names(docs.select(F.regexp_replace("outer", r"\.[^.]*$", "").alias("inner")), docs)


def highlight_sentence(spark: SparkSession, d: str) -> DataFrame:
    of = load(spark, d, "term_candidates").select(F.col("id").alias("term_candidate_id"), "term_id").distinct()
    rows = load(spark, d, "term_occurrences").select("id", "term_candidate_id", "sentence_text").distinct().join(of, "term_candidate_id")
    named = rows.join(load(spark, d, "terms").select(F.col("id").alias("term_id"), "term_text"), "term_id")
    return named.select("id", t.highlighted(F.col("sentence_text"), F.col("term_text")).alias("marked"))


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.document_lookup(load(spark, d, "documents"))


def admission_check(spark: SparkSession, d: str) -> DataFrame:
    return catalog.admission(load(spark, d, "documents"))


def mime_hash(spark: SparkSession, d: str) -> DataFrame:
    ext = t.extension(F.col("original_name"))
    return load(spark, d, "documents").select("doc_id", ext.alias("extension"), t.mime_type(ext).alias("mime"), F.sha2("text", 256).alias("hash"), t.is_uuid(F.col("id")).alias("uuid"))


def run_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.run_status(load(spark, d, "documents"))


def refused_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs without a readable document: of the stored runs, and of each document taken for a run of its own, so that there are some."""
    docs = load(spark, d, "documents")
    single = docs.select("status", "error_message", "size_bytes", F.col("id").alias("extraction_run_id"))
    return catalog.refused_runs(single.unionByName(docs.select("status", "error_message", "size_bytes", "extraction_run_id")))


def page_marked_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents put together from a table of pages, here the least sentence of each page of the occurrences."""
    rows = load(spark, d, "term_occurrences").where("page_number IS NOT NULL")
    pages = rows.groupBy(F.col("document_id").alias("id"), F.col("page_number").alias("page")).agg(F.min("sentence_text").alias("text"))
    return files.page_marked(pages, "id")


def mojibake_names(spark: SparkSession, d: str) -> DataFrame:
    """File names as a client sends them that reads UTF-8 as Latin-1, put right again, beside plain ones."""
    docs = load(spark, d, "documents").select("doc_id", "original_name")
    broken = docs.select("doc_id", F.decode(F.encode("original_name", "UTF-8"), "ISO-8859-1").alias("sent"))
    return broken.select("doc_id", t.mojibake_repaired(F.col("sent")).alias("repaired")).join(docs.select("doc_id", t.mojibake_repaired(F.col("original_name")).alias("kept")), "doc_id")


def stored_terms_of_run(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's rows for the terms that an extraction returns."""
    texts = _returned(spark, d).select(F.col("term").alias("normalized_text"))
    return catalog.stored_of(load(spark, d, "terms"), texts).select("id", "normalized_text", "review_status", "review_version")


def extraction_run(spark: SparkSession, d: str) -> DataFrame:
    """The run rows of an extraction over all documents."""
    return plan_jobs.extraction_run(load(spark, d, "documents"), load(spark, d, "terms"), THRESHOLD)["runs"]


def rows_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table has left after the runs that never ended are deleted, and how many terms could be deleted then."""
    tables = {n: load(spark, d, n) for n in ("extraction_runs", "documents", "terms", "term_candidates", "term_occurrences", "term_review_history")}
    left = catalog.without_runs(tables, tables["extraction_runs"].where("status = 'processing'"))
    left["deletable_terms"] = catalog.deletable_terms(left["terms"], left["term_candidates"], left["term_review_history"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in left.items()]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


def result_json(spark: SparkSession, d: str) -> DataFrame:
    return plan_jobs.results(load(spark, d, "documents"), _files(spark, d), THRESHOLD)


def docx_text(spark: SparkSession, d: str) -> DataFrame:
    """A DOCX, a text and an unknown file, written and read again."""
    workspace = Workspace(spark, "docx")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>閉そく方式を変更した。</w:t></w:r></w:p><w:p><w:r><w:t>信号を確認。</w:t></w:r></w:p></w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", body)
    for name, content in (("manual.docx", packed.getvalue()), ("notes.txt", "駅長へ連絡。".encode()), ("empty.md", b" "), ("scan.png", b"x")):
        workspace.put(name, content)
    return files.read_documents(spark, f"{workspace.root}/files").drop("path")


def _script_tagger() -> models.Tagger:
    """A tagger's place taken by scripts: each run of one script is a word, hiragana are particles, kanji beside katakana are noun chunks."""
    import re

    kinds = {"NOUN": "[一-龥々〆ヵヶ]+|[ァ-ヴー]+|[A-Za-z]+", "NUM": "[0-9]+", "SYM": r"[%℃°+\-]", "ADP": "[ぁ-ん]+", "PUNCT": "(?s:.)"}
    word = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in kinds.items()))
    chunk = re.compile(SCRIPT_CHUNK)
    return lambda s: ([(m.group(), m.lastgroup, m.start()) for m in word.finditer(s)], [(m.group(), m.start()) for m in chunk.finditer(s)])


def _length_scorer() -> models.Scorer:
    """A model's place taken by the term's length."""
    return lambda sentences, terms: [models.softmax([0.0, len(b) / 8])[1] for _, b in zip(sentences, terms)]


def nlp_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both generators over words tagged by their script."""
    return models.tagged_candidates(extract.segment(load(spark, d, "documents")), _script_tagger, "script_tagger").select("doc_id", "sentence_idx", "start_char", "end_char", "term", "source")


def tagged_terms(spark: SparkSession, d: str) -> DataFrame:
    """The general extraction over tagged words with the heuristic score."""
    out = models.extract_with(load(spark, d, "documents"), THRESHOLD, (_script_tagger, "script_tagger"), sentences=False)
    return out.select("doc_id", "sentence_idx", "overlap_rank", "start_char", "end_char", "term", "source", "raw_frequency", "score", "group")


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """The general extraction over tagged words, scored by length in a model's place."""
    out = models.extract_with(load(spark, d, "documents"), 0.6, (_script_tagger, "script_tagger"), (_length_scorer, "length_scorer"), sentences=False)
    return out.select("doc_id", "sentence_idx", "overlap_rank", "start_char", "end_char", "term", "score")


def streaming_extract(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "documents").schema
    return jobs.stream_extract(spark, _stream_source(d, "documents"), schema, Workspace(spark, "stream-extract"), THRESHOLD).select("doc_id", "rank", "term", "frequency", "score")


def streaming_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    return jobs.stream_attempts(spark, _stream_source(d, "events"), schema, Workspace(spark, "stream-limit"), 2 * 86_400 * 1_000_000)


def _stream_source(d: str, name: str) -> str:
    """A table as a stream's source: its folder, or a pattern that matches its one file."""
    return f"{d}/{name}.parquet" if os.path.isdir(f"{d}/{name}.parquet") else f"{d}/{name}.parque[t]"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.status_history(load(spark, d, "term_review_history"), Workspace(spark, "p4"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        extract_terms_by_doc,
        sentence_segments,
        candidate_spans,
        top_terms_per_doc,
        top_terms_of_long_text,
        term_examples_pages,
        confidence_histogram,
        result_totals,
        aggregate_across_docs,
        pages_by_file,
        clean_and_validate,
        heuristic_scores,
        overlap_resolution,
        catalog_upsert,
        persist_candidates,
        persist_occurrences,
        json_recordset,
        constraint_violations,
        list_terms_page,
        list_terms_search,
        list_terms_reviewed,
        term_usage,
        listing_range,
        term_detail,
        status_and_dates,
        term_evidence,
        review_history,
        review_summary,
        checked_requests,
        apply_reviews_cas,
        reviewed_terms,
        appended_history,
        login_rate_limit,
        training_rows,
        training_csv_lines,
        training_jsonl_lines,
        candidate_csv_lines,
        client_view,
        client_view_of_file,
        client_orders,
        aggregate_totals,
        terms_with_review,
        next_unreviewed,
        response_occurrences,
        fuzzy_file_match,
        highlight_sentence,
        document_lookup,
        admission_check,
        mime_hash,
        run_status_rollup,
        refused_runs,
        page_marked_text,
        mojibake_names,
        stored_terms_of_run,
        extraction_run,
        rows_after_deletion,
        result_json,
        docx_text,
        nlp_candidates,
        tagged_terms,
        model_scores,
        streaming_extract,
        streaming_rate_limit,
        p4_found,
    )
}
