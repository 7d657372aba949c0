import json
import zipfile
from datetime import datetime

from shirabe.sources import files, sinks

ROW = "term string, label string, review_status string, context string, file_name string, page int, extraction_score double, review_note string, reviewed_by_name string, reviewed_at timestamp_ntz, term_id string, document_id string, occurrence_id string"


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("信号".encode() + b"\xff")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "ok.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>閉</w:t><w:tab/><w:t>そく</w:t></w:r></w:p></w:body></w:document>')
    rows = {r["file_name"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"]["text"] == "信号�" and rows["a.TXT"]["error"] is None and len(rows["a.TXT"]["sha256"]) == 64
    assert rows["empty.md"]["error"] == "no_text" and rows["empty.md"]["text"] is None
    assert rows["bad.docx"]["error"].startswith("unreadable") and rows["p.pdf"]["error"] == "unknown_type"
    assert rows["ok.docx"]["text"] == "閉\tそく\n\n"
    assert rows["p.pdf"]["mime_type"] == "application/pdf"


def test_page_marked(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 10, None), (1, 1, "a")], "doc_id bigint, page int, text string")
    assert files.page_marked(pages).first()["text"] == "[[PAGE 1]]\na\n[[PAGE 2]]\nb\n[[PAGE 10]]\n"


def training(spark):
    at = datetime(2024, 5, 1, 1, 2, 3, 456789)
    return spark.createDataFrame([("=x", "positive", "approved", '"q"', "f", None, 0.5, None, "n", at, "t", "d", "o1"), ("b", "negative", "rejected", "c\nd", "f", 2, 1.0, "note", "n", None, "t", "d", "o2")], ROW)


def joined(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_training_csv_bytes(spark, tmp_path):
    sinks.write_training_csv(training(spark), str(tmp_path / "csv"))
    text = joined(tmp_path / "csv").decode()
    assert text.startswith('﻿"term","label"') and "\r\n" in text
    assert '"\'=x","positive","approved","""q""","f","","0.5","","n","2024-05-01T01:02:03.456Z","t","d"' in text
    assert text.index("'=x") < text.index('"b"')


def test_training_json(spark, tmp_path):
    sinks.write_training_json(training(spark), str(tmp_path / "json"))
    rows = [json.loads(line) for line in joined(tmp_path / "json").decode().split("\n") if line]
    assert rows[0]["page"] is None and list(rows[0])[0] == "term" and rows[1]["reviewedAt"] is None


def test_candidate_csv_has_all_pages_and_files(spark, monkeypatch):
    from shirabe.functions import constants
    from shirabe.operators import extract

    monkeypatch.setattr(constants, "FILE_RUN", 2)
    texts = ["[[PAGE 10]]\n信号を確認。\n[[PAGE 2]]\n信号の故障。", "[[PAGE 2]]\n信号。", "[[PAGE 1]]\n信号。", "信号。踏切。", "[[PAGE 3]]\n信号。"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    files = spark.createDataFrame([(1, "z.txt"), (2, 'a"b.txt'), (3, "c.txt"), (4, "z.txt"), (5, "a.txt")], "doc_id bigint, file_name string")
    terms = extract.across_documents(extract.extract(docs, 0.5), files, 0.5, lists=True)
    lines = {r["term"]: r["line"] for r in sinks.candidate_csv(terms).collect()}
    assert lines["信号"].startswith('"信号",') and '"1, 2, 3, 10","z.txt; a""b.txt; c.txt; a.txt","railwayHint"' in lines["信号"]
    assert '"\'-","z.txt","railwayHint"' in lines["踏切"]


def extracted(spark):
    from shirabe.operators import extract

    docs = spark.createDataFrame([(1, "[[PAGE 2]]\n信号と信号。\n[[PAGE 3]]\n信号。踏切。"), (2, "信号。"), (3, "のみ。")], "doc_id bigint, text string")
    files = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "c.txt")], "doc_id bigint, file_name string")
    sentences = extract.segment(docs)
    terms = extract.terms_by_document(extract.candidates(sentences), 0.5, occurrences=True)
    return terms, extract.document_summary(sentences, terms), files


def test_result_json_lists_every_occurrence(spark):
    terms, summary, files = extracted(spark)
    rows = {r["doc_id"]: json.loads(r["json"]) for r in sinks.result_json(terms, summary, files, 0.5).collect()}
    first = next(x for x in rows[1]["terms"] if x["term"] == "信号")
    assert [(o["sentence"], o["page"], o["startChar"], o["endChar"]) for o in first["occurrences"]] == [("信号と信号。", 2, 0, 2), ("信号と信号。", 2, 3, 5), ("信号。", 3, 0, 2)]
    assert {o["score"] for o in first["occurrences"]} == {first["score"]} and len(first["occurrences"]) == first["frequency"]
    assert (first["candidate"], first["sentence"], first["sentence_id"], first["start_char"], first["end_char"]) == ("信号", "信号と信号。", "a.txt_s0", 0, 2)
    assert rows[2]["terms"][0]["occurrences"][0]["page"] is None and rows[3]["terms"] == []


def test_response_has_the_first_occurrences(spark):
    from shirabe.operators import extract

    terms, _, files = extracted(spark)
    got = {r["term"]: [(o["fileName"], o["documentId"], o["startChar"], o["page"]) for o in r["occurrences"]] for r in extract.response_occurrences(terms, files, 0.5).collect()}
    assert got == {"信号": [("a.txt", 1, 0, 2), ("a.txt", 1, 3, 2), ("a.txt", 1, 0, 3), ("b.txt", 2, 0, None)], "踏切": [("a.txt", 1, 0, 3)]}
    two = {r["term"]: len(r["occurrences"]) for r in extract.response_occurrences(terms, files, 0.5, limit=2).collect()}
    assert two == {"信号": 2, "踏切": 1}
