import random
from datetime import datetime, timedelta

from shirabe.llm import dedup
from shirabe.llm.bare import bare_text
from shirabe.llm.chunks import FINE, chunk_texts, packed_chunks, packed_pieces
from shirabe.tables import Workspace

DAY = datetime(2024, 1, 1)
WORDS = [f"語{chr(0x4E00 + 7 * i)}{chr(0x5E00 + 3 * i)}" for i in range(900)]


def test_bare():
    assert bare_text("﻿[[PAGE 3]]\r\nＡｂ、１２\n x[[PAGE 4]]\n[[PAGE 5]]") == "ab12xpage4"
    assert bare_text(None) == bare_text("。、 ") == ""


def test_chunks_are_local_and_whole():
    random.seed(1)
    text = "".join(random.choice(WORDS) for _ in range(300))
    other = text[:400] + "挿入" + text[400:]
    a, b = (set(packed_chunks([x], 8)[0].tolist()) for x in (text, other))
    assert len(a & b) / len(a) > 0.95
    number, hashes, size = chunk_texts([text, "", "ab", text], 8)
    assert size[number == 0].sum() == len(text) and size[number == 2].sum() == 2 and not (number == 1).any()
    assert (hashes[number == 0] == hashes[number == 3]).all() and size.max() <= 16
    assert [len(x) for x in packed_chunks([], 8)] == [] and len(packed_chunks([""], 8)[0]) == 0


def test_pieces_of_short_texts():
    texts = ["", "abcd", "abcde", "abcdeabcde" * 20, "xabcdeabcd", "abcdeabcde"]
    number, packed = packed_pieces(texts, 5, 128)
    of = {i: set(packed[number == i].tolist()) for i in set(number.tolist())}
    assert sorted(of) == [2, 4, 5] and [len(of[i]) for i in (2, 4, 5)] == [1, 6, 5]
    assert of[2] <= of[4] and of[5] - of[4] == set() and all(c & FINE and c & 0x7FFF == 1 for c in packed.tolist())
    assert [len(x) for x in packed_pieces([], 5, 128)] == [0, 0]


def jaccard(a, b):
    p = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} or {t}
    return len(p(a) & p(b)) / len(p(a) | p(b))


def corpus(seed, hot):
    """Texts of 200 characters and more with copies and near copies, some of them of each other; no pair is similar to 50 to 70 %."""
    random.seed(seed)
    docs = []
    for i in range(160):
        kind = random.random()
        words = random.sample(WORDS, random.randint(70, 130))
        if docs and kind < 0.15:
            words = list(random.choice(docs))
        elif docs and kind < 0.45:
            words = list(random.choice(docs))
            for _ in range(max(1, len(words) // 50)):
                words[random.randrange(len(words))] = random.choice(WORDS)
        docs.append(words)
    base = random.sample(WORDS, 100)
    for i in range(hot):  # near copies of one text, all different
        words = list(base)
        words[i % 100] = WORDS[(7 * i) % 900]
        docs.append(words)
    random.shuffle(docs)
    texts = ["。".join(w) for w in docs]
    shares = [jaccard(bare_text(a), bare_text(b)) for i, a in enumerate(texts) for b in texts[:i]]
    assert not any(0.5 < s < 0.7 for s in shares)
    return texts


def expected(docs):
    accepted, out = [], set()
    for doc_id, _, text in sorted(docs, key=lambda d: (d[1], d[0])):
        bare = bare_text(text)
        if not bare:
            continue
        first = next((a for a, b in accepted if jaccard(bare, b) >= 0.6), None)
        if first is None:
            accepted.append((doc_id, bare))
        else:
            out.add((min(doc_id, first), max(doc_id, first)))
    return out


def run(spark, texts, batches, params=dedup.DedupParams()):
    random.seed(9)
    order = random.sample(range(1000), len(texts))
    runs = [(f"r{k}", DAY + timedelta(days=(k * 7) % 11), 1) for k in range(11)]
    docs = [(i, f"r{random.randrange(11)}", t, 0) for i, t in zip(order, texts)]
    at = {r: d for r, d, _ in runs}
    D = spark.createDataFrame(docs, "doc_id bigint, extraction_run_id string, text string, at int")
    R = spark.createDataFrame(runs, "id string, created_at timestamp_ntz, doc_id int")
    found = dedup.repeats(D, R, Workspace(spark, "t"), batches, params).collect()
    got = {(min(r["doc_id"], r["repeats"]), max(r["doc_id"], r["repeats"])) for r in found}
    assert len(found) == len(got)
    return got, expected([(i, at[r], t) for i, r, t, _ in docs if t])


def test_one_and_several_batches(spark):
    texts = corpus(2, 0) + [None, "", "。。", "短い"]
    got, want = run(spark, texts, 1)
    assert got == want and len(want) > 30
    got, want = run(spark, texts, 3)
    assert got == want


def test_hot_group_in_rounds(spark):
    got, want = run(spark, corpus(3, 60), 2, dedup.DedupParams(heads=3))
    assert got == want and len(want) > 80


def test_short_texts_are_all_found(spark):
    random.seed(12)
    texts = []
    for _ in range(60):
        words = random.sample(WORDS, random.randint(7, 30))
        texts.append("".join(words))
        if random.random() < 0.7:
            words[random.randrange(len(words))] = random.choice(WORDS)
            texts.append("".join(words))
    at = {i: i for i in range(len(texts))}
    want = expected([(i, at[i], t) for i, t in enumerate(texts)])
    D = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id bigint, at bigint, text string")
    history = dedup.ChunkHistory(Workspace(spark, "t"))
    got = {(r["repeats"], r["doc_id"]) for part in (D.where("at < 50"), D.where("at >= 50")) for r in history.add(part).collect()}
    assert got == want and len(want) > 15


def test_common_text_across_batches(spark):
    """A third of the rows are half one common text, in both batches; few of them repeat each other."""
    random.seed(13)
    common = "".join(random.sample(WORDS, 40))
    texts = [common + "".join(random.sample(WORDS, 40)) for _ in range(50)]
    texts += [t[:-6] + "末尾" for t in texts[:8]] + ["".join(random.sample(WORDS, 60)) for _ in range(100)]
    random.shuffle(texts)
    docs = [(i, i, t) for i, t in enumerate(texts)]
    D = spark.createDataFrame(docs, "doc_id bigint, at bigint, text string")
    for params in (dedup.DedupParams(), dedup.DedupParams(heads=4, hot=10, common_share=0.2)):
        history = dedup.ChunkHistory(Workspace(spark, "t"), params)
        got = {(r["repeats"], r["doc_id"]) for part in (D.where("at < 80"), D.where("at >= 80")) for r in history.add(part).collect()}
        assert got == expected(docs) and len(got) == 8


def test_a_later_session_goes_on(spark, tmp_path):
    random.seed(14)
    texts = ["".join(random.sample(WORDS, 50)) for _ in range(20)]
    rows = lambda of, first: spark.createDataFrame([(first + i, first + i, t) for i, t in enumerate(of)], "doc_id bigint, at bigint, text string")
    folder = f"file://{tmp_path}/history"
    history = dedup.ChunkHistory(Workspace(spark, "t"), path=folder)
    assert history.add(rows(texts, 0)).count() == 0
    history.close()
    other = spark.newSession()
    again = dedup.ChunkHistory(Workspace(other, "t"), path=folder)
    near = texts[3][:70] + "別" + texts[3][71:]
    got = again.add(rows([texts[7], "".join(random.sample(WORDS, 50)), near, near], 100)).collect()
    assert {(r["doc_id"], r["repeats"]) for r in got} == {(100, 7), (102, 3), (103, 3)}
    # What a batch that was broken off has left is not read.
    third = dedup.ChunkHistory(Workspace(spark, "t"), path=folder)
    third._store("seen", spark.createDataFrame([(bytearray(b"x" * 16), 5)], "digest binary, rep_id bigint"), "digest", 1)
    assert {(r["doc_id"], r["repeats"]) for r in third.add(rows([near, texts[0], texts[1]], 200)).collect()} == {(200, 3), (201, 0), (202, 1)}
    assert [b["number"] for b in third.batches] == [0, 1, 2]


def test_empty(spark):
    D = spark.createDataFrame([], "doc_id bigint, extraction_run_id string, text string")
    R = spark.createDataFrame([], "id string, created_at timestamp_ntz")
    assert dedup.found_pairs(D, R, Workspace(spark, "t")).count() == 0
