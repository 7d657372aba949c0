import math
import random

from shirabe.llm import leaks
from shirabe.llm.bare import bare_text


def longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = prev[j] + 1
                best = max(best, row[j + 1])
        prev = row
    return best


def test_automaton_against_plain_python():
    random.seed(6)
    for _ in range(150):
        items = ["".join(random.choice("abc") for _ in range(random.randint(1, 25))) for _ in range(random.randint(1, 5))]
        needs = [max(1, math.ceil(0.4 * len(t))) for t in items]
        automaton = leaks.SuffixAutomaton(items, needs)
        text = "".join(random.choice("abc") for _ in range(40)) + random.choice(items)[: random.randint(0, 20)]
        want = {i: longest(t, text) for i, t in enumerate(items) if longest(t, text) >= needs[i]}
        got = automaton.longest(text)
        assert {i: n for i, (n, _) in got.items()} == want
        assert all(text[end - n : end] in items[i] for i, (n, end) in got.items())


ITEMS = [(1, "次の文を読み答えよ。架線の高さは常に五メートルを保つものとする。"), (2, "Choose the best answer. The signal stays dark for nine days."), (3, None), (4, "。。"), (2, "Choose the best answer. The signal stays dark for nine days.")]


def tables(spark):
    docs = [(1, "前置き。架線の高さは常に五メート\nルを保つものとする。終わり。", 0), (2, "nothing here", 0), (3, None, 0), (4, "", 0), (5, "XX the SIGNAL stays dark, for nine days yy", 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_tables(spark):
    docs, items = tables(spark)
    want = [(1, 1), (5, 2), (5, 2)]
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()) == want
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items, block_chars=10).collect()) == want
    assert leaks.leaks(docs, items.limit(0)).count() == leaks.leaks(docs.limit(0), items).count() == 0
    share = leaks.leaks(docs, items).where("doc_id = 1").first()
    assert share["matched_chars"] == longest(bare_text(ITEMS[0][1]), bare_text(docs.first()["text"]))


def test_cleaned(spark):
    docs, items = tables(spark)
    got = {r["doc_id"]: r for r in leaks.cleaned(docs, items, drop_share=0.9).collect()}
    assert got[1]["text"] == "前置き。。終わり。" and not got[1]["dropped"]
    assert got[2]["text"] == "nothing here" and got[3]["text"] is None and got[4]["text"] == ""
    assert leaks.cleaned(docs, items, drop_share=0.1).where("dropped").count() == 2


def test_stretches_against_plain_python():
    random.seed(7)
    for _ in range(150):
        items = ["".join(random.choice("abc") for _ in range(random.randint(1, 25))) for _ in range(random.randint(1, 5))]
        needs = [max(1, math.ceil(0.4 * len(t))) for t in items]
        text = "".join(random.choice("abc") for _ in range(40)) + random.choice(items)[: random.randint(0, 20)] * 2
        want = {k for t, n in zip(items, needs) for a in range(len(text) - n + 1) if text[a : a + n] in t for k in range(a, a + n)}
        got = leaks.SuffixAutomaton(items, needs).stretches(text)
        assert {k for a, b in got for k in range(a, b)} == want
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_cleaned_cuts_every_copy(spark):
    item = "架線の高さは常に五メートルを保つものとする"
    docs = spark.createDataFrame([(1, f"前。{item}。中程の文。{item}。後。"), (2, f"甲{item[:12]}乙丙丁戊{item[9:]}己庚辛壬癸")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "常に五メートルを保つものとする規則である")], "item_id bigint, text string")
    for block_chars in (200_000, 1):
        got = {r["doc_id"]: r for r in leaks.cleaned(docs, items, drop_share=0.95, block_chars=block_chars).collect()}
        assert (got[1]["text"], got[1]["removed_chars"]) == ("前。。中程の文。。後。", 2 * len(item))
        assert (got[2]["text"], got[2]["removed_chars"]) == ("甲乙丙丁戊己庚辛壬癸", len(item) + 3)


def test_nothing_leaks_from_what_is_cleaned(spark):
    """Over several passes of small blocks, with items that stand whole, in part and more than once."""
    random.seed(11)
    signs = [chr(0x4E00 + 5 * i) for i in range(60)]
    items = [(i, "".join(random.choice(signs) for _ in range(random.randint(12, 40)))) for i in range(40)]
    docs = []
    for i in range(60):
        parts = ["".join(random.choice(signs) for _ in range(30)) for _ in range(4)]
        for _, text in random.sample(items, random.randint(0, 3)):
            parts.insert(random.randint(0, len(parts)), text[: random.randint(len(text) // 2, len(text))] * random.randint(1, 2))
        docs.append((i, "。".join(parts)))
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i) for d, t in docs for i, x in items if longest(x, bare_text(t)) >= math.ceil(0.4 * len(x))}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(D, I, block_chars=100).collect()} == want and len(want) > 40
    clean = leaks.cleaned(D, I, drop_share=1.0, block_chars=100)
    left = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(clean, I).collect()}
    bare = {r["doc_id"]: bare_text(r["text"]) for r in clean.collect()}
    # What is left can only have come together over a cut.
    assert all(longest(dict(items)[i], bare[d]) >= math.ceil(0.4 * len(dict(items)[i])) for d, i in left) and len(left) <= 1
