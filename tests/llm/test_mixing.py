from shirabe.llm import mixing


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def weights(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    rows = [(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 10) for i in range(100)] + [(9000, "other", 10)]
    w = weights(spark, ("big", 0.6, 1), (" Small", 0.4, 3), ("none", 0.5, 2), ("zero", 0.0, 1))
    m = mixing.mix(sizes(spark, rows), w, bucket_rows=64)
    report = {r["source"]: r for r in m.shares.collect()}
    assert abs(report["small"]["actual_share"] - 0.4) < 0.01 and abs(report["big"]["actual_share"] - 0.6) < 0.01
    assert report["small"]["repeats"] == 3 and report["small"]["tokens"] == 3000
    assert [round(report[x]["normalized_share"], 6) for x in ("big", "small", "none", "zero")] == [0.6, 0.4, 0, 0]
    assert report["none"]["records"] == 0 and report["none"]["actual_share"] == 0.0
    got = m.records.collect()
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert len({(r["doc_id"], r["repeat"]) for r in got}) == len(got) and "other" not in {r["source"] for r in got}
    half = [r["source"] for r in got[: len(got) // 2]]  # the shares hold in every prefix
    assert abs(half.count("small") / len(half) - 0.4) < 0.02


def test_budget(spark):
    rows = [(i, "a", 7) for i in range(50)] + [(100 + i, "b", 7) for i in range(50)]
    m = mixing.mix(sizes(spark, rows), weights(spark, ("a", 0.5, 1), ("b", 0.5, None)), budget=140)
    assert m.records.count() == 20
    more = mixing.mix(sizes(spark, rows), weights(spark, ("a", 0.5, 2), ("b", 0.5, 1)), budget=10_000)
    assert {r["source"]: r["tokens"] for r in more.shares.collect()} == {"a": 700, "b": 350}


def test_empty_and_null(spark):
    none = mixing.mix(sizes(spark, []), weights(spark, ("a", 0.5, 1)))
    assert none.records.count() == 0 and none.shares.first()["tokens"] == 0
    assert mixing.mix(sizes(spark, [(1, "a", 3)]), weights(spark, ("a", None, 1))).records.count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, " A ", "hello world"), (2, "a", None), (3, None, "x"), (4, "a", "")], "doc_id bigint, source string, text string")
    assert [(r["doc_id"], r["source"]) for r in mixing.token_counts(docs).collect()] == [(1, "a")]
