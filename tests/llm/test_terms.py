import random
import unicodedata
from collections import Counter, defaultdict

from shirabe.llm import terms as t

CAND = "id string, extraction_run_id string, term_id string, frequency int, word int"
TERM = "id string, normalized_text string, n int"


def test_against_plain_python(spark):
    random.seed(3)
    names = ["ATS", "ＡＴＳ", " ATS ", "信号", "架線", "ｼﾝｺﾞｳ", None]
    terms = [(f"t{i}", n, 1) for i, n in enumerate(names)]
    terms.append(("t20", "孤立", 1))
    rows = [(f"c{i}", f"r{random.randint(0, 150)}", f"t{min(int(random.expovariate(0.7)), 8)}", random.choice([None, 1, 2, 5]), 0) for i in range(1500)]
    rows += random.sample(rows, 200) + [("x", None, "t3", 4, 0), ("y", "r1", None, 4, 0)]
    values = {i: unicodedata.normalize("NFKC", n).strip() for i, n, _ in terms if n is not None}
    total, runs = Counter({v: 0 for v in values.values()}), defaultdict(set)
    for _, run, term, n, _ in set(rows):
        if term in values:
            total[values[term]] += 1 if n is None else n
            if run is not None:
                runs[values[term]].add(run)
    all_runs = {r[1] for r in rows if r[1] is not None}
    got = {r["term_value"]: (r["total_frequency"], r["n_runs"], r["mark"]) for r in t.term_frequencies(spark.createDataFrame(rows, CAND), spark.createDataFrame(terms, TERM)).collect()}
    used = {values[r[2]] for r in rows if r[2] in values}
    mark = lambda v: None if v not in used else "rare" if total[v] <= 2 else "common" if len(runs[v]) > len(all_runs) / 2 else None
    assert got == {v: (total[v], len(runs[v]), mark(v)) for v in total}
    assert got["孤立"] == (0, 0, None) and "common" in {x[2] for x in got.values()}


def test_one_id_counts_once(spark):
    rows = [("a", "r1", "t", 5, 0), ("a", "r1", "t", 2, 0), ("a", "r2", "t", 1, 0), (None, "r1", "t", 1, 0), (None, "r1", "t", 1, 0), (None, "r3", "t", None, 0), ("z", "r9", "u", 0, 0)]
    got = {tuple(r) for r in t.term_frequencies(spark.createDataFrame(rows, CAND), spark.createDataFrame([("t", "語", 1), ("u", "無", 1)], TERM)).collect()}
    assert got == {("語", 4, 2, None), ("無", 0, 1, "rare")}


def test_empty(spark):
    assert t.marked_terms(spark.createDataFrame([], CAND), spark.createDataFrame([], TERM)).count() == 0
