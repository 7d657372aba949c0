import random
from datetime import datetime, timedelta

from shirabe.operators import history
from shirabe.tables import Workspace

SCHEMA = "id bigint, term_id string, previous_status string, new_status string, review_version int, created_at timestamp_ntz, block int"
DAY = datetime(2024, 1, 1)
S = ["approved", "Rejected ", "uncertain", "unreviewed"]


def expected(rows):
    held = {}
    for _, term, p, n, v, at, _ in rows:
        if term is None or v is None:
            continue
        row = (at is None, at or DAY, (p or "~").strip().lower(), (n or "~").strip().lower())
        if (term, v) not in held or row < held[term, v]:
            held[term, v] = row
    out = set()
    for term in {t for t, _ in held}:
        starts, before = [], None
        for v in sorted(v for t, v in held if t == term):
            _, at, p, n = held[term, v]
            if before is None or n != p or p != before:
                starts.append((v, n, int((at - datetime(1970, 1, 1)) / timedelta(microseconds=1))))
            before = n
        for i, (v, n, us) in enumerate(starts):
            out.add((term, v, n, us, starts[i + 1][2] if i + 1 < len(starts) else -1))
    return out


def test_status_history(spark):
    random.seed(1)
    rows = []
    for i in range(400):
        rows.append((i, f"t{random.randint(0, 12)}", random.choice(S), random.choice(S), random.randint(1, 30), DAY + timedelta(hours=random.randint(0, 2000)), 7))
    rows += rows[:40] + [(900, None, "approved", "approved", 1, DAY, 7), (901, "t1", "approved", "approved", None, DAY, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    for snapshots in (1, 3):
        got = {tuple(r) for r in history.status_history(df, Workspace(spark, "t"), snapshots).collect()}
        assert got == expected(rows)
    small_blocks = history.status_periods(history.holding_rows(df), block=4)
    assert {tuple(r) for r in small_blocks.collect()} == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert history.status_history(df, Workspace(spark, "t")).count() == 0


def test_snapshots(spark):
    store = history.SnapshotHistory(Workspace(spark, "t"), ["k"], ["v"], fanout=4, depth=2)
    make = lambda d: spark.createDataFrame(list(d.items()), "k string, v string")
    first = {f"k{i}": str(i % 3) for i in range(100)}
    second = {**first, "k3": None, "k4": "new", "extra": "1"}
    del second["k5"]
    assert store.append(make(first)).count() == 100
    fresh = {(r["k"], r["v"], r["gone"]) for r in store.append(make(second)).collect()}
    assert fresh == {("k3", None, False), ("k4", "new", False), ("extra", "1", False), ("k5", "2", True)}
    assert store.append(make(second)).count() == 0
    assert {(r["k"], r["v"]) for r in store.current().collect()} == set(second.items())
    old = store.versions().where("k = 'k5'").collect()
    assert [(r["first_snapshot"], r["last_snapshot"]) for r in old] == [(1, 1)]


def test_only_differing_leaves_are_looked_at(spark):
    store = history.SnapshotHistory(Workspace(spark, "t"), ["k"], ["v"], fanout=4, depth=3)
    rows = spark.range(1000).selectExpr("id AS k", "'a' AS v")
    changed = spark.range(1000).selectExpr("id AS k", "IF(id = 17, 'b', 'a') AS v")
    a, b = store.tree(store._rows(rows)), store.tree(store._rows(changed))
    assert store.changed_leaves(a, b).count() == 1
    assert store.changed_leaves(a, a).count() == 0


def test_a_later_session_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/history"
    make = lambda session, d: session.createDataFrame(list(d.items()), "k string, v string")
    first = {f"k{i}": str(i % 3) for i in range(3000)}
    store = history.SnapshotHistory(Workspace(spark, "t"), ["k"], ["v"], path=folder, leaf_rows=8)
    assert store.append(make(spark, first)).count() == 3000 and store.fanout**store.depth > 300
    other = spark.newSession()
    again = history.SnapshotHistory(Workspace(other, "t"), ["k"], ["v"], path=folder)
    assert (again.snapshots, again.depth) == (1, store.depth)
    second = first | {"k7": "x", "new": "y"}
    del second["k9"]
    assert {tuple(r) for r in again.append(make(other, second)).select("k", "v", "snapshot", "gone").collect()} == {("k7", "x", 2, False), ("new", "y", 2, False), ("k9", "0", 2, True)}
    assert {(r["k"], r["v"]) for r in again.current().collect()} == set(second.items())


def test_equal_terms_keep_the_periods_appended_before(spark):
    """Only terms whose rows changed are worked on again."""
    rows = [(i, f"t{i}", "unreviewed", "approved", 1, DAY, 0) for i in range(40)] + [(90, "t3", "approved", "rejected", 2, DAY + timedelta(1), 0)]
    store = history.SnapshotHistory(Workspace(spark, "t"), ["term_id", "review_version"], ["created_at", "previous_status", "new_status"], entity=["term_id"], leaf_rows=2)
    for n, cut in ((40, 40), (1, 41)):
        store.append(history.holding_rows(spark.createDataFrame(rows[:cut], SCHEMA)))
        changed, of_them = store.changed_entities()
        assert changed.count() == n and of_them.count() == (40 if cut == 40 else 2)
    got = {tuple(r) for r in history.status_history(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), 2).collect()}
    assert got == expected(rows)
