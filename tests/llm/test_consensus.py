import random
from datetime import datetime, timedelta

from shirabe.llm import consensus as c

H = "id bigint, term_id string, new_status string, reviewer_username string, review_version int, created_at timestamp_ntz, degree int"
DAY = datetime(2024, 1, 1)


def test_latest_labels(spark):
    rows = [
        (1, "t", "approved", "Ann ", 1, DAY, 0),
        (1, "t", "approved", "Ann ", 1, DAY, 0),
        (2, "t", "REJECTED ", "ａｎｎ", 2, DAY + timedelta(1), 0),
        (3, "t", "approved", "bob", 3, DAY, 0),
        (4, "t", "unreviewed", "bob", 4, DAY + timedelta(2), 0),
        (5, None, "approved", "bob", 1, DAY, 0),
        (6, "u", None, "ann", 1, DAY, 0),
        (7, "v", "uncertain", "ann", 1, None, 0),
    ]
    got = {tuple(r) for r in c.latest_labels(spark.createDataFrame(rows, H)).collect()}
    assert got == {("t", "ann", 1), ("v", "ann", 2)}


def simulated(n=500, seed=5):
    """Labels by eleven good, two poor, two always-approving and one guessing reviewer, and the truth."""
    random.seed(seed)
    skill = {f"r{i}": (0.95 - 0.03 * i if i < 11 else 0.55) for i in range(13)}
    truth, rows = {}, []
    for i in range(n):
        truth[f"t{i}"] = t = random.choices([0, 1, 2], [50, 38, 12])[0]
        for r in random.sample([f"r{k}" for k in range(16)], random.randint(3, 6)) + random.sample(["r13", "r14"], random.randint(0, 1)):
            if r in ("r13", "r14"):
                label = 0 if random.random() < 0.9 else t
            elif r == "r15":
                label = random.randint(0, 2)
            else:
                label = t if random.random() < skill[r] else random.choice([x for x in range(3) if x != t])
            rows.append((f"t{i}", r, label))
    return truth, list({(t, r): (t, r, x) for t, r, x in rows}.values())


def test_beats_majority(spark):
    truth, rows = simulated()
    out = c.consensus(spark.createDataFrame(rows, "term_id string, reviewer string, label int"))
    got = {r["term_id"]: r["consensus_status"] for r in out.terms.collect()}
    votes = {}
    for t, _, x in rows:
        votes.setdefault(t, []).append(x)
    majority = sum(max(set(v), key=v.count) == truth[t] for t, v in votes.items()) / len(truth)
    ours = sum(c.STATUSES.index(got[t]) == truth[t] for t in truth) / len(truth)
    assert ours > majority + 0.03 and ours > 0.9
    assert out.converged and out.terms.where("NOT converged").count() == 0
    damped = c.consensus(spark.createDataFrame(rows, "term_id string, reviewer string, label int"), damped_after=2)
    assert damped.converged and sum(r["consensus_status"] != got[r["term_id"]] for r in damped.terms.collect()) <= 2
    early = c.consensus(spark.createDataFrame(rows, "term_id string, reviewer string, label int"), most_rounds=1)
    assert not early.converged and early.terms.where("NOT converged").count() > 0
    reliable = {r["reviewer"]: r["reliability"] for r in out.reviewers.collect()}
    assert reliable["r0"] > reliable["r7"] > reliable["r12"] > reliable["r15"] and reliable["r15"] < 0.5
    agreement = {r["term_id"]: r["agreement"] for r in out.terms.collect()}
    t, v = next((t, v) for t, v in votes.items() if len(v) == 4)
    pairs = [(a, b) for i, a in enumerate(v) for b in v[:i]]
    assert abs(agreement[t] - sum(a == b for a, b in pairs) / len(pairs)) < 1e-9


def test_small_cases(spark):
    assert c.consensus(spark.createDataFrame([], "term_id string, reviewer string, label int")).terms.count() == 0
    row = c.consensus(spark.createDataFrame([("t", "r", 1, 5)], "term_id string, reviewer string, label int, degree int")).terms.first()
    assert (row["consensus_status"], row["n_reviewers"], row["agreement"]) == ("rejected", 1, None)
