import random
from datetime import datetime

from pyspark.sql import functions as F

from shirabe.operators import catalog, names, review

DAY = datetime(2024, 5, 1)
TERM = "id string, term_text string, normalized_text string, review_status string, review_note string, reviewed_by_username string, reviewed_by_name string, reviewed_at timestamp_ntz, review_version int, created_at timestamp_ntz, updated_at timestamp_ntz, frequency int"
CAND = "id string, extraction_run_id string, term_id string, score decimal(5,4), frequency int, candidate_group string, extraction_source string, created_at timestamp_ntz"
OCC = "id string, term_candidate_id string, document_id string, page_number int, sentence_text string, start_char int, end_char int, score decimal(5,4), created_at timestamp_ntz"


def term(i, status="unreviewed", text=None, at=None):
    return (f"t{i}", text or f"語{i}", text or f"語{i}", status, None, None, None, at, 0, DAY, DAY, 99)


def tables(spark):
    from decimal import Decimal as D

    terms = spark.createDataFrame([term(1, "approved"), term(2, "rejected", "100%"), term(3), term(4, "uncertain", "=a_b")], TERM)
    cands = [("c1", "r1", "t1", D("0.5"), None, "g", "s", DAY), ("c2", "r2", "t1", D("0.7"), 4, "g", "s", DAY), ("c3", "r1", "t2", D("0.9"), 2, "g", "s", DAY)]
    occs = [("o1", "c1", "d1", None, "文一", None, None, D("0.5"), DAY), ("o2", "c2", "d1", 2, "文二", 0, 1, D("0.5"), DAY), ("o3", "c2", "d2", 1, "文三", 0, 1, D("0.5"), DAY), ("o4", "c3", "d2", 1, "文四", 0, 1, D("0.5"), DAY)]
    docs = spark.createDataFrame([("d1", "b.txt", 1), ("d2", "a.txt", 1)], "id string, original_name string, term_id int").drop("term_id")
    runs = spark.createDataFrame([("r1", DAY), ("r2", datetime(2024, 6, 1))], "id string, created_at timestamp_ntz")
    return terms, spark.createDataFrame(cands + cands[:1], CAND), spark.createDataFrame(occs + occs[:2], OCC), docs, runs


def test_listing(spark):
    terms, cands, occs, _, _ = tables(spark)
    rows = catalog.list_terms(terms, cands, occs, limit=3, offset=1).orderBy("position").collect()
    assert [r["position"] for r in rows] == [2, 3, 4]
    assert {(r["filtered_count"], r["total"]) for r in rows} == {(3, 4)}
    usage = {r["id"]: (r["frequency"], r["document_count"], r["score"]) for r in catalog.term_stats(terms, cands, occs).collect()}
    assert usage == {"t1": (5, 2, 0.7), "t2": (2, 1, 0.9), "t3": (0, 0, None), "t4": (0, 0, None)}
    assert catalog.list_terms(terms, cands, occs, status="reviewed").count() == 3
    assert [r["id"] for r in catalog.list_terms(terms, cands, occs, search="１００％").collect()] == ["t2"]
    assert catalog.list_terms(terms, cands, occs, search="_").count() == 4
    assert terms.where(catalog.search_filter("_", escape=True)).count() == 1
    assert catalog.list_terms(terms.limit(0), cands, occs).count() == 0


def test_page_bounds():
    assert catalog.page_bounds() == (50, 0)
    assert catalog.page_bounds("500", "-3") == (100, 0)
    assert catalog.page_bounds("x", 7) == (50, 7)


def test_evidence_and_training(spark):
    terms, cands, occs, docs, runs = tables(spark)
    rows = catalog.term_evidence(cands, occs, docs, runs).where("term_id = 't1'").orderBy("evidence_rank").collect()
    assert [(r["id"], r["file_name"], r["page_number"]) for r in rows] == [("o3", "a.txt", 1), ("o2", "b.txt", 2), ("o1", "b.txt", None)]
    assert catalog.term_evidence(cands, occs, docs, runs, limit=1).count() == 2
    train = catalog.training_rows(terms, cands, occs, docs).orderBy(*catalog.training_order()).collect()
    assert [(r["occurrence_id"], r["label"]) for r in train] == [("o4", "negative"), ("o3", "positive"), ("o2", "positive"), ("o1", "positive")]


def test_new_terms(spark):
    terms = tables(spark)[0]
    extracted = spark.createDataFrame([(2, "ＡＴＳ"), (1, "ATS"), (1, "語1"), (1, " "), (1, None)], "doc_id bigint, term string")
    assert [tuple(r) for r in catalog.new_terms(terms, extracted).collect()] == [("ATS", "ATS")]


def test_review_fold_against_plain_python(spark):
    random.seed(2)
    terms = spark.createDataFrame([term(i) for i in range(6)], TERM)
    rows = [(i, random.choice([f"t{k}" for k in range(7)] + [None]), random.choice(["approved", "rejected", "unreviewed"]), random.choice(["", "n", None]), random.randint(0, 3), "u", i) for i in range(200)]
    requests = spark.createDataFrame(rows, "seq bigint, term_id string, status string, note string, expected_version int, reviewer string, at_us bigint")
    state, want = {f"t{k}": (0, "unreviewed") for k in range(6)}, {}
    for seq, t, status, *_, _, at in [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows]:
        if t is None:
            continue
        expected = rows[seq][4]
        if t not in state:
            want[seq] = ("not_found", None, None)
        elif state[t][0] != expected:
            want[seq] = ("conflict", state[t][0], state[t][1])
        else:
            want[seq] = ("updated", expected + 1, state[t][1])
            state[t] = (expected + 1, status)
    out = review.review_outcomes(terms, requests)
    assert {r["seq"]: (r["kind"], r["version"], r["previous_status"]) for r in out.collect()} == want
    after = {r["id"]: (r["review_version"], r["review_status"]) for r in review.reviewed_terms(terms, out).collect()}
    assert after == state
    assert review.appended_history(out).count() == sum(v[0] == "updated" for v in want.values())


def test_attempt_limit(spark):
    minute = 60_000_000
    rows = [("a", i, i * minute, False) for i in range(7)] + [("a", 7, 16 * minute, False), ("b", 1, 0, False), ("b", 2, 1, True), ("b", 3, 15 * minute, False)]
    df = spark.createDataFrame(rows, "key string, seq bigint, at_us bigint, ok boolean")
    got = {(r["key"], r["seq"]): (r["outcome"], r["failures"]) for r in review.attempt_outcomes(df).collect()}
    assert [got["a", i] for i in range(8)] == [("failed", i + 1) for i in range(5)] + [("blocked", 5)] * 2 + [("failed", 1)]
    assert [got["b", i] for i in (1, 2, 3)] == [("failed", 1), ("ok", 0), ("failed", 1)]


def test_names(spark):
    outer = spark.createDataFrame([("manual_12.pdf",), ("manual_1",), ("ab",), ("",), (None,)], "outer string")
    inner = spark.createDataFrame([("manual_1",), ("ab",), ("zz",), ("",), (None,)], "inner string")
    assert {tuple(r) for r in names.contained_names(inner, outer).collect()} == {("manual_1", "manual_12.pdf"), ("manual_1", "manual_1"), ("ab", "ab")}


def test_unique_files(spark):
    df = spark.createDataFrame([(i, f"n{i % 30}", i % 30) for i in range(90)], "pos int, name string, size int")
    rows = catalog.unique_files(df, ["name", "size"], "pos").collect()
    assert [r["pos"] for r in rows] == list(range(20))


def test_status_filters(spark):
    terms = tables(spark)[0]
    assert terms.where(catalog.status_filter(None)).count() == 4
    assert catalog.review_summary(terms).first().asDict() == {"total": 4, "unreviewed": 1, "approved": 1, "rejected": 1, "uncertain": 1, "reviewed": 3}
    assert F.lit(1) is not None


def test_client_filter_searches_all_files_and_the_status(spark):
    from shirabe.operators import extract

    docs = spark.createDataFrame([(1, "信号。踏切。"), (2, "信号。架線。"), (3, "架線。")], "doc_id bigint, text string")
    files = spark.createDataFrame([(1, "a.txt"), (2, "ＭＡＮＵＡＬ.pdf"), (3, "c.txt")], "doc_id bigint, file_name string")
    terms = extract.across_documents(extract.extract(docs, 0.5), files, 0.5, lists=True, separator=" ").select("term", "files", "group")
    stored = spark.createDataFrame([("信号", "rejected", 1), ("信号", "approved", 2), ("架線", "unreviewed", 0)], "normalized_text string, review_status string, review_version int")
    shown = lambda **how: sorted(r["term"] for r in catalog.client_filter(terms, stored, **how).collect())
    assert shown(search=" manual") == ["信号", "架線"] and shown(search="a.txt manual") == ["信号"] and shown(search="踏") == ["踏切"]
    assert shown(status="approved") == ["信号"] and shown(status="unreviewed") == ["架線", "踏切"] and shown(status="rejected") == []
    assert shown() == ["信号", "架線", "踏切"] and shown(group="none") == []


def test_totals_and_next_unreviewed(spark):
    from shirabe.operators import extract

    terms = spark.createDataFrame([("信号", 0.9, 3), ("架線", 0.69, 2), ("踏切", 0.7, 2), ("ＡＴＳ", 0.6, 9)], "term string, score double, frequency int")
    assert extract.aggregate_summary(terms).first().asDict() == {"term_count": 4, "mode": "demo", "review_needed": 2}
    stored = spark.createDataFrame([("信号", "approved", 1), ("ATS", "rejected", 1), ("架線", "unreviewed", 0)], "normalized_text string, review_status string, review_version int")
    merged = catalog.with_review_status(terms, stored)
    assert {r["term"]: r["review_status"] for r in merged.collect()} == {"信号": "approved", "架線": "unreviewed", "踏切": "unreviewed", "ＡＴＳ": "rejected"}
    assert [r["term"] for r in catalog.next_unreviewed(merged, "信号").collect()] == ["踏切"]
    assert [r["term"] for r in catalog.next_unreviewed(merged, "踏切").collect()] == ["架線"]


def test_persisted_rows_have_the_catalogs_ids(spark):
    terms = spark.createDataFrame([("t1", "信号"), ("t2", None)], "id string, normalized_text string")
    at = lambda page, sentence: [(sentence, page, 0, 2, 0.9)]
    found = spark.createDataFrame(
        [(1, " 信号", 2, 0.9, "s", "g", at(1, "信号。")), (2, "ＡＴＳ", 1, 0.8, "s", "g", at(1, "x")), (3, "信号", 1, 0.95, "s", "g", at(None, ""))],
        "doc_id bigint, term string, frequency int, score double, source string, group string, occurrences array<struct<sentence:string,page:int,startChar:int,endChar:int,score:double>>",
    )
    documents = spark.createDataFrame([(1, "r1", "d1", "k1"), (2, "r1", "d2", None), (3, "r1", "d3", "k3")], "doc_id bigint, extraction_run_id string, id string, storage_key string")
    stored = catalog.stored_terms(terms, found)
    assert {tuple(r) for r in stored.collect()} == {("信号", "t1"), ("ATS", "new:ATS")}
    assert {(r["id"], r["frequency"], r["score"]) for r in catalog.run_candidates(found, documents, stored).collect()} == {("r1|t1", 3, 0.95), ("r1|new:ATS", 1, 0.8)}
    rows = catalog.run_occurrences(found, documents, stored).collect()
    assert [(r["term_candidate_id"], r["document_id"], r["page_number"]) for r in rows] == [("r1|t1", "d1", 1)]


def test_runs_without_a_readable_document_are_refused(spark):
    documents = spark.createDataFrame([("a", "failed", None, 1), ("a", "processed", "x", 1), ("b", "processed", None, None), ("c", "failed", None, 1), ("c", "processed", None, 2**21)], "extraction_run_id string, status string, error_message string, size_bytes bigint")
    assert {(r[0], r[1]) for r in catalog.run_status(documents).collect()} == {("b", "completed"), ("c", "completed_with_errors")}
    assert [tuple(r) for r in catalog.refused_runs(documents).collect()] == [("a", 2)]


def test_checked_requests(spark):
    from shirabe.operators import review

    rows = [(1, "approved", " ok　", "0"), (2, "Approved", None, "1"), (3, "rejected", "", "-1"), (4, "rejected", "", None), (5, "rejected", "", "1.5"), (6, "uncertain", " " + "注" * 2000 + " ", "3"), (7, "uncertain", "注" * 2001, "3"), (8, "uncertain", "𠮷" * 1001, "3"), (9, None, None, "x")]
    got = {r["id"]: r for r in review.checked_requests(spark.createDataFrame(rows, "id int, status string, note string, version string")).collect()}
    assert {i: r["error"] for i, r in got.items()} == {1: None, 2: "status", 3: "version", 4: "version", 5: "version", 6: None, 7: "note", 8: "note", 9: "status"}
    assert got[1]["note"] == "ok" and got[1]["expected_version"] == 0 and len(got[6]["note"]) == 2000 and got[2]["note"] == ""


def test_page_range():
    assert catalog.page_range(0, 50, 0) == (0, 0) and catalog.page_range(120, 50, 100) == (101, 120)
