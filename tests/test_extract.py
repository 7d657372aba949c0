import random

from shirabe.operators import extract
from shirabe.plans import models

TEXT = "[[PAGE 2]]\n閉そく方式を変更する。\n閉そく方式を確認する。"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def test_two_sentences(spark):
    rows = extract.extract(docs(spark, TEXT), 0.5).orderBy("rank").collect()
    assert [(r["term"], r["score"], r["frequency"], r["pages"]) for r in rows] == [("方式", 0.56, 2, [2]), ("変更", 0.52, 1, [2]), ("確認", 0.52, 1, [2])]
    assert rows[0]["examples"] == ["閉そく方式を変更する。", "閉そく方式を確認する。"]
    sentences = extract.segment(docs(spark, TEXT))
    summary = extract.document_summary(sentences, extract.extract(docs(spark, TEXT), 0.5)).first()
    assert tuple(summary) == (1, 2, 3, 0, 0, 3)


def test_nulls_empties_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (2, "", "x", 5), (3, "踏切を点検", "x", 5), (4, " \n ", "x", 5)], "doc_id bigint, text string, term string, sentence_idx int")
    assert [(r["doc_id"], r["term"]) for r in extract.extract(df, 0.5).orderBy("rank").collect()] == [(3, "踏切"), (3, "点検")]
    empty = df.limit(0)
    assert extract.extract(empty, 0.5).count() == 0
    files = spark.createDataFrame([], "doc_id bigint, file_name string")
    assert extract.across_documents(extract.extract(empty, 0.5), files, 0.5).count() == 0


def test_general_path_equals_the_short_one(spark):
    texts = [TEXT, "ATSとATC。ATS装置。\nホームドア", "信号機、信号機。第3章信号"]
    short = extract.extract(docs(spark, *texts), 0.5).select("doc_id", "term", "frequency", "score")
    rows = models.extract_with(docs(spark, *texts), 0.5)
    general = rows.groupBy("doc_id", "term").agg({"score": "max", "*": "count"})
    assert {(r["doc_id"], r["term"], r["frequency"], r["score"]) for r in short.collect()} == {(r["doc_id"], r["term"], r["count(1)"], r["max(score)"]) for r in general.collect()}


def test_inside_a_row_equals_grouping_rows(spark):
    random.seed(8)
    parts = ["信号機", "ATS", "3章架線", "を", "の", "。", "\n", "第2節踏切", "[[PAGE 7]]\n", "ホームドア", "、", "信号機", "ーー"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(40)] + [TEXT, "", "[[PAGE 3]]"]
    wide = docs(spark, *texts)
    grouped = extract.terms_by_document(extract.candidates(extract.segment(wide)), 0.5, occurrences=True)
    narrow = extract.extract(wide, 0.5, occurrences=True).drop("sentence_count")
    assert sorted(grouped.columns) == sorted(narrow.columns)
    rows = lambda df: {(r["doc_id"], r["rank"]): r.asDict(recursive=True) for r in df.collect()}
    assert rows(narrow) == rows(grouped) and narrow.count() > 200


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-(s[1] - s[0]), -s[2], -s[3], s[0], s[1])):
        if all(max(s[0], o[0]) >= min(s[1], o[1]) for o in kept):
            kept.append(s)
    return kept


def test_overlaps(spark):
    random.seed(4)
    rows = [(0, 0, 5, 0.9, 1), (0, 3, 9, 0.8, 1), (0, 9, 12, 0.7, 1), (0, 4, 6, 0.95, 1)]
    for g in range(1, 40):
        for _ in range(random.randint(1, 12)):
            a = random.randint(0, 30)
            rows.append((g, a, a + random.randint(1, 8), random.choice([0.5, 0.6, 0.7]), random.randint(1, 3)))
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "s int, start_char int, end_char int, score double, raw_frequency int")
    got = {}
    for r in extract.resolve_overlaps(df, ["s"]).orderBy("s", "overlap_rank").collect():
        got.setdefault(r["s"], []).append((r["start_char"], r["end_char"], r["score"], r["raw_frequency"]))
    for g in {r[0] for r in rows}:
        assert got[g] == greedy([r[1:] for r in rows if r[0] == g])
    assert [s[:2] for s in got[0]] == [(3, 9), (9, 12)]


def test_spans_without_offsets_overlap_nothing(spark):
    rows = [(1, 0, 5, 0.9, 1), (1, 3, 9, 0.8, 1), (1, None, 7, 0.8, 1), (1, 2, None, 0.8, 1), (1, None, None, 0.8, 1), (1, 4, 4, 0.8, 1)]
    df = spark.createDataFrame(rows, "s int, start_char int, end_char int, score double, raw_frequency int")
    kept = {(r["start_char"], r["end_char"]) for r in extract.resolve_overlaps(df, ["s"]).collect()}
    assert kept == {(3, 9), (None, 7), (2, None), (None, None), (4, 4)}


def test_counts_come_before_duplicates(spark):
    """Two generators give one span: it counts twice, and the first one's source stays."""
    tag = lambda: lambda s: ([("信号", "NOUN", 0), ("機", "NOUN", 2), ("を", "ADP", 3), ("ATS", "PROPN", 4), ("ーー", "NOUN", 7), ("盤", "X", 9)], [("信号機", 0)])
    documents = docs(spark, "信号機をATSーー盤。")
    rows = {(r["term"], r["start_char"], r["end_char"]): r for r in models.extract_with(documents, 0.5, (tag, "two")).collect()}
    assert set(rows) == {("信号機", 0, 3), ("ATS", 4, 7)}
    assert rows["信号機", 0, 3]["raw_frequency"] == 2 and rows["信号機", 0, 3]["source"] == "ginza_noun_chunk" and rows["信号機", 0, 3]["score"] == 0.78
    assert rows["ATS", 4, 7]["raw_frequency"] == 1 and rows["ATS", 4, 7]["source"] == "ginza_compound"
    none = lambda: lambda s: ([("これ", "PRON", 0)], [])
    back = models.extract_with(documents, 0.5, (none, "none")).collect()
    assert {r["source"] for r in back} == {"regex_candidate"} and "信号機" in {r["term"] for r in back}


def test_ranked(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 AS v", "id % 3 AS g")
    rows = extract.ranked(df, [df["g"].desc(), df["v"].asc()]).collect()
    assert [(r["g"], r["v"]) for r in sorted(rows, key=lambda r: r["rank"])] == sorted(((r["g"], r["v"]) for r in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001)) and extract.ranked(df.limit(0), [df["v"].asc()]).count() == 0


def test_across(spark):
    terms = extract.extract(docs(spark, "信号を確認。", "信号の故障。信号。", "信号線。信号"), 0.5)
    files = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "a.txt")], "doc_id bigint, file_name string")
    row = extract.across_documents(terms, files, 0.5).where("term = '信号'").first()
    assert (row["frequency"], row["n_files"], row["first_file"], row["score"]) == (4, 2, "a.txt", 0.78)
    assert row["examples"] == ["a.txt: 信号を確認。", "b.txt: 信号の故障。", "b.txt: 信号。"]


def test_one_payload(spark):
    from shirabe.plans import jobs

    payload = {"text": "[[PAGE 2]]\n閉そく方式を確認する。閉そく方式を変更する。", "threshold": 0.5, "fileName": "sample.pdf", "modelDir": "/missing"}
    result = jobs.extract_one(spark, payload)
    repeated = next(term for term in result["terms"] if term["term"] == "方式")
    assert (result["mode"], repeated["frequency"], [o["page"] for o in repeated["occurrences"]]) == ("demo", 2, [2, 2])
    assert all("方式" in o["sentence"] for o in repeated["occurrences"]) and repeated["sentence_id"] == "sample.pdf_s0"
    assert jobs.extract_one(spark, {"text": None})["terms"] == []


def test_a_run(spark):
    from shirabe.plans import jobs

    columns = "doc_id bigint, id string, extraction_run_id string, original_name string, storage_key string, text string, status string, error_message string, size_bytes bigint"
    rows = [(1, "d1", "r1", "a.txt", "k1", "信号を確認。信号の故障。", "processed", None, 9), (2, "d2", "r1", "b.txt", None, None, "failed", "unreadable", 9), (3, "d3", "r2", "c.txt", None, None, "failed", "unreadable", 9)]
    stored = spark.createDataFrame([("t1", "信号", "approved", 3)], "id string, normalized_text string, review_status string, review_version int")
    out = {n: df.collect() for n, df in jobs.extraction_run(spark.createDataFrame(rows, columns), stored, 0.5).items()}
    assert [tuple(r) for r in out["runs"]] == [("r1", "completed_with_errors", 2, 1, 2, 3)] and [r[0] for r in out["refused"]] == ["r2"]
    assert {r["normalized_text"] for r in out["terms"]} == {"確認", "故障"} and {r["term_id"] for r in out["candidates"]} == {"t1", "new:確認", "new:故障"}
    assert {(r["term_candidate_id"], r["document_id"]) for r in out["occurrences"]} == {("r1|t1", "d1"), ("r1|new:確認", "d1"), ("r1|new:故障", "d1")}
    assert {(r["term"], r["review_status"], r["files"]) for r in out["aggregate"]} == {("信号", "approved", "a.txt"), ("確認", "unreviewed", "a.txt"), ("故障", "unreviewed", "a.txt")}
    assert {r["term"]: len(r["occurrences"]) for r in out["response"]} == {"信号": 2, "確認": 1, "故障": 1}


def test_python_rules_equal_columns(spark):
    """What the general extraction's Python stage cleans and scores is what the columns do."""
    from pyspark.sql import functions as F

    from shirabe.functions import text as t

    random.seed(3)
    signs = "第3章節(12)）.ー-信号機ATSぁんの・「」 \u2028\u0085\x1c\u3000\n閉そく%"
    texts = list({"".join(random.choice(signs) for _ in range(random.randint(1, 9))) for _ in range(600)})
    cleaned = t.clean_candidate(F.col("x"))
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.when(t.valid_candidate(cleaned), cleaned).alias("term")).collect()
    assert {r["x"]: r["term"] for r in rows} == {x: t.term_of_text(x) for x in texts} and sum(r["term"] is not None for r in rows) > 100
    grid = [(term, n) for term in ("ア", "信", "信号", "信号機構", "ATS", "ABCD", "線区ホーム", "装置アイ") for n in range(1, 40)]
    scored = spark.createDataFrame(grid, "term string, n int").select("term", "n", t.heuristic_score(F.col("term"), F.col("n")).alias("score")).collect()
    assert all(r["score"] == t.term_score(r["term"], r["n"]) for r in scored)


def test_the_general_extraction_shuffles_nothing(spark):
    tag = lambda: lambda s: ([("信号", "NOUN", 0)], [])
    score = lambda: lambda sentences, terms: [0.75 for _ in terms]
    out = models.extract_with(docs(spark, "信号を確認。", "", "の。"), 0.5, (tag, "one"), (score, "flat"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    assert [(r["doc_id"], r["term"], r["score"], r["sentence"], r["page"]) for r in out.where("doc_id = 1").collect()] == [(1, "信号", 0.75, "信号を確認。", None)]


def test_a_sentence_of_several_documents_is_tagged_and_scored_once():
    import pyarrow as pa

    seen, scored = [], []

    def tag(sentence):
        seen.append(sentence)
        return [("信号", "NOUN", 0)], []

    def score(sentences, terms):
        scored.extend(zip(sentences, terms))
        return [0.9] * len(terms)

    one = [{"page": None, "sentence": "信号を確認。"}, {"page": 2, "sentence": "信号の灯。"}]
    out = models._kept_spans(pa.array([[], one, one[:1]]).slice(1), tag, score, 0.5).to_pylist()
    assert sorted(seen) == ["信号の灯。", "信号を確認。"]
    assert sorted(scored) == [("信号の灯。", "信号"), ("信号を確認。", "信号")]
    assert [[(x["sentence_idx"], x["term"], x["raw_frequency"]) for x in d] for d in out] == [[(0, "信号", 2), (1, "信号", 2)], [(0, "信号", 1)]]
