"""Term extraction: documents to sentences, candidates, scored and ranked terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.functions import constants as k
from shirabe.functions import text as t
from shirabe.tables import Workspace, spread


def clamp_threshold(value: object) -> float:
    """A request's threshold: the default where it is no finite number, kept within its bounds."""
    import math

    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        number = math.nan
    return min(max(number, k.THRESHOLD_LOW), k.THRESHOLD_HIGH) if math.isfinite(number) else k.THRESHOLD_DEFAULT


def segment(documents: DataFrame, key: str = "doc_id", text: str = "text", terminators: str = k.TERMINATORS) -> DataFrame:
    """(key, sentence_idx, page, sentence): one row per sentence, numbered from 0 in a document.

    A narrow plan: one Arrow stage for NFKC, all else on arrays inside the row.
    Null and empty texts give no rows.
    """
    return records(documents, key, text, terminators).select(key, F.posexplode("_records").alias("sentence_idx", "_r")).select(key, "sentence_idx", F.col("_r.page").alias("page"), F.col("_r.sentence").alias("sentence"))


def records(documents: DataFrame, key: str, text: str, terminators: str = k.TERMINATORS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, _records) and the ``carried`` columns: each document's array of (page, sentence)."""
    # No filter on the normalized text: it would be pushed down and normalize everything twice.
    normal = spread(documents.select(key, text, *carried).where(F.col(text) != "")).select(key, *carried, t.normalize_text(F.col(text)).alias("_text"))
    found = normal.select(key, *carried, "_text", t.paged_sentences(F.col("_text"), terminators).alias("_found"))
    records = F.when(F.size("_found") > 0, F.col("_found")).otherwise(t.unpaged_sentences(F.col("_text"), terminators))
    return found.select(key, *carried, records.alias("_records"))


def candidates(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences with (start_char, end_char, term, source) of each candidate."""
    spans = sentences.select(key, "sentence_idx", "page", "sentence", F.inline(t.candidate_spans(F.col("sentence"))))
    return spans.withColumnRenamed("candidate", "term").withColumn("source", F.lit(k.REGEX_SOURCE))


def resolve_overlaps(rows: DataFrame, sentence: list[str]) -> DataFrame:
    """Of overlapping spans of a sentence those that come first by length, score and frequency.

    ``rows`` has the columns ``sentence`` (its key), start_char, end_char,
    score, raw_frequency and any others. A span is kept if it overlaps none
    already kept; spans that touch do not overlap. Ties go to the earlier start,
    then the earlier end, then the other columns' order. Spans with a null or
    empty extent overlap nothing and are kept. One fold per sentence, over that
    sentence's spans only.
    """
    order = lambda c: F.struct((c["start_char"] - c["end_char"]).alias("a"), (-c["score"]).alias("b"), (-c["raw_frequency"]).alias("c"), c["start_char"].alias("d"), c["end_char"].alias("e"))
    rest = [c for c in rows.columns if c not in sentence]
    spans = rows.select(*sentence, F.struct(*rest).alias("span"))
    spans = spans.select(*sentence, F.struct(order(F.col("span")).alias("rank"), F.col("span").alias("span")).alias("one"))
    grouped = spans.groupBy(*sentence).agg(F.array_sort(F.collect_list("one")).alias("ordered"))
    # Each comparison by itself, as greatest and least would pass over nulls.
    clash = lambda a, b: F.coalesce((a["start_char"] < b["end_char"]) & (b["start_char"] < a["end_char"]) & (a["start_char"] < a["end_char"]) & (b["start_char"] < b["end_char"]), F.lit(False))
    kind = rows.select(F.struct(*rest).alias("s")).schema["s"].dataType.simpleString()
    kept = F.aggregate(
        "ordered",
        F.array().cast(f"array<{kind}>"),
        lambda acc, one: F.when(F.exists(acc, lambda o: clash(o, one["span"])), acc).otherwise(F.concat(acc, F.array(one["span"].cast(kind)))),
    )
    return grouped.select(*sentence, F.posexplode(kept).alias("overlap_rank", "_s")).select(*sentence, "overlap_rank", "_s.*")


def terms_by_document(rows: DataFrame, threshold: float, key: str = "doc_id", occurrences: bool = False) -> DataFrame:
    """One row per document and term of candidates that don't overlap, as the pattern generator's.

    Columns: frequency, raw_frequency, score, group, source, page (first of the
    sorted pages), pages, examples (first three different sentences),
    first_sentence_idx, start_char, end_char, rank (by score, frequency, term).
    With ``occurrences`` also all of them, ordered by sentence, length (longest
    first) and start: sentence, page, startChar, endChar, score.
    Equal to scoring, threshold, overlap resolution and aggregation one after
    the other, as a document's counts are known once its terms are grouped, so
    one shuffle does both. Its groups are one document's occurrences of a term.
    """
    first = F.min(F.struct("sentence_idx", (F.col("start_char") - F.col("end_char")).alias("shorter"), "start_char", "end_char", "source"))
    seen = ["sentence_idx", "sentence"]
    if occurrences:
        seen = ["sentence_idx", (F.col("start_char") - F.col("end_char")).alias("shorter"), "start_char", "end_char", "page", "sentence"]
    grouped = rows.groupBy(key, "term").agg(
        F.count("*").cast("int").alias("frequency"),
        first.alias("first"),
        F.min("page").alias("page"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.array_sort(F.collect_list(F.struct(*seen))).alias("seen"),
    )
    score = t.heuristic_score(F.col("term"), F.col("frequency"))
    out = grouped.withColumn("score", score).where(F.col("score") >= threshold)
    every = F.transform("seen", lambda o: F.struct(o["sentence"].alias("sentence"), o["page"].alias("page"), o["start_char"].alias("startChar"), o["end_char"].alias("endChar"), F.col("score").alias("score"))) if occurrences else None
    out = out.select(
        key,
        "term",
        "frequency",
        F.col("frequency").alias("raw_frequency"),
        "score",
        t.group_tag(F.col("term")).alias("group"),
        F.col("first.source").alias("source"),
        "page",
        "pages",
        F.slice(F.array_distinct(F.col("seen.sentence")), 1, k.MAX_EXAMPLES).alias("examples"),
        F.col("first.sentence_idx").alias("first_sentence_idx"),
        F.col("first.start_char").alias("start_char"),
        F.col("first.end_char").alias("end_char"),
        *([every.alias("occurrences")] if occurrences else []),
    )
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("frequency"), "term")
    return out.withColumn("rank", F.row_number().over(order))


def extract(documents: DataFrame, threshold: float = k.THRESHOLD_DEFAULT, key: str = "doc_id", text: str = "text", examples: bool = True, occurrences: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ranked terms of each document, without a shuffle; the columns of ``terms_by_document``, ``sentence_count`` and the document's ``carried`` ones.

    All that a term's row says is in its document's row, so terms are counted,
    scored and ranked there; nothing is grouped across rows, and a document takes
    memory by its own text. Without ``examples`` no sentence is carried along.
    """
    found = records(documents, key, text, carried=carried).withColumn("_terms", t.document_terms(F.col("_records"), occurrences))
    at = lambda i: F.get("_records", i)

    def one(x: Column) -> Column:
        score = t.heuristic_score(x["term"], x["frequency"], traits=x["traits"])
        rest = [x[c].alias(c) for c in ("page", "pages", "sentence_idx", "start_char", "end_char")]
        if examples:
            rest.append(F.transform(x["seen"], lambda i: at(i)["sentence"]).alias("examples"))
        if occurrences:
            told = lambda o: F.struct(at(o["sentence_idx"])["sentence"].alias("sentence"), at(o["sentence_idx"])["page"].alias("page"), o["start_char"].alias("startChar"), o["end_char"].alias("endChar"), score.alias("score"))
            rest.append(F.transform(x["places"], told).alias("occurrences"))
        return F.struct((-score).alias("lower"), (-x["frequency"]).alias("rarer"), x["term"].alias("term"), *rest)

    ordered = F.array_sort(F.filter(F.transform("_terms", one), lambda x: -x["lower"] >= threshold))
    rows = found.select(key, *carried, F.size("_records").alias("sentence_count"), F.posexplode(ordered).alias("_at", "_t"))
    return rows.select(
        key,
        F.col("_t.term").alias("term"),
        (-F.col("_t.rarer")).alias("frequency"),
        (-F.col("_t.rarer")).alias("raw_frequency"),
        (-F.col("_t.lower")).alias("score"),
        t.group_tag(F.col("_t.term")).alias("group"),
        F.lit(k.REGEX_SOURCE).alias("source"),
        F.col("_t.page").alias("page"),
        F.col("_t.pages").alias("pages"),
        *([F.col("_t.examples").alias("examples")] if examples else []),
        F.col("_t.sentence_idx").alias("first_sentence_idx"),
        F.col("_t.start_char").alias("start_char"),
        F.col("_t.end_char").alias("end_char"),
        *([F.col("_t.occurrences").alias("occurrences")] if occurrences else []),
        (F.col("_at") + 1).alias("rank"),
        "sentence_count",
        *carried,
    )


def top_terms(terms: DataFrame, limit: int = k.MAX_TERMS_PER_DOCUMENT) -> DataFrame:
    """The terms returned for a document; counts over a document are taken before this."""
    return terms.where(F.col("rank") <= limit)


def document_summary(sentences: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_count, term_count, high, medium, review_needed) over all terms of a document."""
    counted = terms.groupBy(key).agg(
        F.count("*").cast("int").alias("term_count"),
        F.count_if(F.col("score") >= 0.9).cast("int").alias("high"),
        F.count_if((F.col("score") >= 0.7) & (F.col("score") < 0.9)).cast("int").alias("medium"),
        F.count_if(F.col("score") < 0.7).cast("int").alias("review_needed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sentences.groupBy(key).agg(F.count("*").cast("int").alias("sentence_count")).join(counted, key, "left").select(key, "sentence_count", *map(zero, ("term_count", "high", "medium", "review_needed")))


def with_file_names(terms: DataFrame, files: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Terms with their document's ``file_name`` from ``files``; without ``files`` they carry it already.

    The size of extracted terms is not known before they are made (an array
    counts as one element), so they must not look small enough to be broadcast.
    """
    if files is None:
        return terms.where(F.col(key).isNotNull())
    return terms.join(files.select(key, "file_name").hint("merge"), key)


def file_lists(rows: DataFrame, key: str = "doc_id", separator: str = "; ") -> DataFrame:
    """(term, files, first_page): each term's different file names, joined, in the order of their first documents, and the lowest page in those of the first name.

    A common term's names are joined in runs of ``FILE_RUN`` and the runs after
    that, so that no aggregation holds more than its runs' text.
    """
    named = rows.groupBy("term", "file_name").agg(F.min(key).alias("_first"), F.min("page").alias("_page"))
    placed = named.withColumn("_run", F.floor((F.row_number().over(Window.partitionBy("term").orderBy("_first", "file_name")) - 1) / k.FILE_RUN))
    joined = lambda place, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, F.col(text).alias("t")))), lambda x: x["t"]), separator, "")
    runs = placed.groupBy("term", "_run").agg(joined(F.struct("_first", "file_name").alias("p"), "file_name").alias("_text"), F.min_by("_page", F.struct("_first", "file_name")).alias("_page"))
    return runs.groupBy("term").agg(joined(F.col("_run").alias("p"), "_text").alias("files"), F.min_by("_page", "_run").alias("first_page"))


def across_documents(terms: DataFrame, files: DataFrame | None, threshold: float, key: str = "doc_id", lists: bool = False, separator: str = "; ", evidence: bool = True) -> DataFrame:
    """One row per term over all documents, from each document's returned terms.

    ``files`` has (key, file_name); without it the terms carry their file_name.
    Columns: frequency, n_files, first_file, score with source and group of its
    first best document, and as ``evidence`` examples (first three, each after
    its file's name), n_pages, page (the lowest).
    A term's pages per file stay rows (``pages_by_file``). With ``lists`` there
    are also its sorted different pages (with ``evidence``), its files, joined by
    ``separator``, and the lowest page of its first file.
    Documents come in the order of the key. Rows that several aggregations read
    are written once; without ``evidence`` no sentence is.
    """
    rows = with_file_names(terms.where(F.col("score") >= threshold), files, key)
    rows = rows.select(key, "term", "frequency", "score", "source", "group", "page", "file_name", *["pages", "examples"][: 2 * evidence])
    if lists or evidence:
        rows = Workspace(rows.sparkSession, "across").write(rows)
    out = rows.groupBy("term").agg(
        F.sum("frequency").alias("frequency"),
        F.countDistinct("file_name").cast("int").alias("n_files"),
        F.min_by("file_name", key).alias("first_file"),
        F.max("score").alias("score"),
        F.min_by(F.struct("source", "group"), F.struct((-F.col("score")).alias("s"), key)).alias("best"),
    )
    if evidence:
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("_n") <= k.MAX_EXAMPLES)
        named = F.transform("examples", lambda e: F.concat("file_name", F.lit(": "), e))
        examples = first.groupBy("term").agg(F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", named.alias("e")))), lambda x: x["e"]))), 1, k.MAX_EXAMPLES).alias("examples"))
        pages = rows.select("term", F.explode("pages").alias("page")).groupBy("term").agg(F.countDistinct("page").cast("int").alias("n_pages"), F.min("page").alias("page"), *[F.array_sort(F.collect_set("page")).alias("pages")][:lists])
        out = out.join(examples.hint("merge"), "term").join(pages.hint("merge"), "term", "left")
    if lists:
        out = out.join(file_lists(rows, key, separator).hint("merge"), "term")
    told = ["examples", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "page", *["pages"][:lists]] if evidence else []
    return out.select("term", "frequency", "n_files", "first_file", "score", "best.source", "best.group", *told, *["files", "first_page"][: 2 * lists])


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their place in a total order over all of them, from 1.

    The rows are sorted by range and written with their place in their part;
    what goes before a part is a sum over one row a part. No task holds more
    than its range.
    """
    placed = Workspace(rows.sparkSession, "ranked").write(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(rank, (within + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")


def aggregate_order() -> list[Column]:
    """The order of terms over all documents: score, frequency, then the term in Japanese order; the last column makes it total."""
    return [F.desc("score"), F.desc("frequency"), F.asc(F.collate("term", "ja")), F.asc("term")]


def frequency_order() -> list[Column]:
    """The client's order by frequency: ties stay in the order of the aggregate."""
    return [F.desc("frequency"), *aggregate_order()]


def source_order() -> list[Column]:
    """The client's order by source of terms aggregated with ``lists``: first file and its lowest page, ties as in the aggregate."""
    return [F.asc(F.collate(t.source_key("first_file", "first_page"), "ja")), *aggregate_order()]


def response_occurrences(terms: DataFrame, files: DataFrame | None, threshold: float, key: str = "doc_id", limit: int = k.MAX_RESPONSE_OCCURRENCES) -> DataFrame:
    """(term, occurrences): a term's first ``limit`` over all documents, in the order of the key, each with its document and file.

    ``terms`` are each document's returned terms with ``occurrences``. Every
    document of a term has one at least, so its first ``limit`` documents do.
    """
    rows = with_file_names(terms.where(F.col("score") >= threshold), files, key).select(key, "term", "file_name", F.slice("occurrences", 1, limit).alias("_o"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("_n") <= limit)
    whole = F.transform("_o", lambda o: F.struct(*[o[c].alias(c) for c in ("sentence", "page", "startChar", "endChar", "score")], F.col("file_name").alias("fileName"), F.col(key).alias("documentId")))
    listed = first.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("_n", whole.alias("o")))).alias("_l"))
    return listed.select("term", F.slice(F.flatten(F.transform("_l", lambda x: x["o"])), 1, limit).alias("occurrences"))


def pages_by_file(terms: DataFrame, files: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(term, file_name, pages): the sorted pages of a term in all documents of one file name."""
    rows = with_file_names(terms, files, key).select("term", "file_name", F.explode_outer("pages").alias("page"))
    return rows.groupBy("term", "file_name").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def totals(summary: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """One row over all documents: file, sentence and character counts. Characters are UTF-16 units of the raw text."""
    units = F.length("text") + F.length(F.regexp_replace("text", r"[^\x{10000}-\x{10FFFF}]", ""))
    chars = documents.where("text IS NOT NULL AND text <> ''").select(F.lit(1).alias("f"), units.alias("c"), F.lit(0).alias("s"))
    both = chars.unionByName(summary.select(F.lit(0).alias("f"), F.lit(0).alias("c"), F.col("sentence_count").alias("s")))
    return both.agg(F.sum("f").alias("file_count"), F.sum("s").alias("sentence_count"), F.sum("c").alias("character_count")).withColumn("threshold", F.lit(threshold))


def aggregate_summary(terms: DataFrame, mode: str = "demo") -> DataFrame:
    """(term_count, mode, review_needed): one row over the terms of all documents."""
    return terms.agg(F.count("*").alias("term_count"), F.lit(mode).alias("mode"), F.count_if(F.col("score") < 0.7).alias("review_needed"))
