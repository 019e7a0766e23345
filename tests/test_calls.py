"""Calls that fail, answers that are kept, and questions that most rows share."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import answers, calls, matchers
from pairlens.operators.calls import AnswerStore, Caller, Counts


def frame(n):
    return pd.DataFrame({"q": [f"q{i}" for i in range(n)]})


def test_failures_end_at_the_row_that_fails():
    sizes = []

    def call(pdf):
        sizes.append(len(pdf))
        if pdf["q"].isin(["q3", "q17"]).any():
            raise RuntimeError("bad row")
        return pdf["q"].str.upper()

    got, status = calls.answered(frame(40), call, tries=2, wait=0)
    assert [i for i, s in enumerate(status) if s != "ok"] == [3, 17] and status[3] == "failed: RuntimeError"
    assert got == [None if i in (3, 17) else f"Q{i}" for i in range(40)]
    assert sizes[0] == 40 and len(sizes) < 30


def test_a_row_is_tried_again_and_a_dead_service_is_left():
    tried, waits = {}, []

    def late(pdf):
        if len(pdf) > 1:
            raise TimeoutError
        n = tried[pdf["q"].iloc[0]] = tried.get(pdf["q"].iloc[0], 0) + 1
        if n < 3:
            raise TimeoutError
        return pdf["q"]

    got, status = calls.answered(frame(8), late, tries=3, wait=0)
    assert got == [f"q{i}" for i in range(8)] and set(status) == {"ok"} and set(tried.values()) == {3}

    def dead(pdf):
        waits.append(len(pdf))
        raise ConnectionError

    got, status = calls.answered(frame(1000), dead, tries=2, wait=0)
    assert set(got) == {None} and status.count("failed: ConnectionError") == calls.GIVE_UP and status.count("failed: not asked") == 1000 - calls.GIVE_UP
    assert len(waits) < 100
    short, status = calls.answered(frame(4), lambda pdf: pdf["q"].iloc[:1], tries=1, wait=0)
    assert short == ["q0", "q1", "q2", "q3"]  # too few answers count as a failure of the batch


def test_store_keeps_answers_and_forgets_failures(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    rows = spark.createDataFrame([(i, f"q{i % 5}" if i % 7 else None) for i in range(30)], "id int, q string")

    def some(pdf):
        if (pdf["q"] == "q2").any():
            raise RuntimeError
        return pdf["q"].fillna("none").str.upper()

    first = Caller(some, store, wait=0)
    out = {r["id"]: (r["_answer"], r["_status"]) for r in first(rows, ["q"]).collect()}
    assert out[1] == ("Q1", "ok") and out[0] == ("NONE", "ok") and out[2] == (None, "failed: RuntimeError") and len(out) == 30
    assert first.counts == Counts(30, 6, 0, 1)
    second = Caller(lambda pdf: pdf["q"].str.lower(), store, wait=0)
    out = {r["id"]: r["_answer"] for r in second(rows, ["q"]).collect()}
    assert second.counts == Counts(30, 6, 5, 0) and out[2] == "q2" and out[1] == "Q1"
    (tmp_path / "store" / "answers-broken").mkdir()  # a run that died
    store.compact(spark)
    assert store.known(spark).count() == 6 and len(store._parts(spark)) == 1
    third = Caller(some, store, wait=0)
    third(rows, ["q"]).collect()
    assert third.counts == Counts(30, 6, 6, 0)


def test_hot_questions_are_dealt_over_tasks(spark):
    rows = spark.range(20000, numPartitions=8).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id").cast("string"))).alias("k"))
    few = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("answer", F.upper("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        joined = calls.spread(rows, few, "k", "n")
        assert joined.where(F.col("answer") != F.upper("k")).count() == 0 and joined.count() == 20000
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(sizes) < 4 * 20000 / 50


@pytest.mark.parametrize("hot", [False, True])
def test_any_matcher_decides_equal_pairs_once(spark, hot):
    rows = spark.createDataFrame([(str(i), "a" if hot and i % 10 else f"a{i}", "a") for i in range(200)], "pair_id string, ltable_x string, rtable_x string")
    m = matchers.PandasMatcher(lambda pdf: (pdf["ltable_x"] == pdf["rtable_x"]).astype(float))
    got = m.decide(rows, *matchers.sides(rows), "d")
    assert got.where("d = 1").count() == (180 if hot else 0) and got.count() == 200
    assert m.counts == Counts(200, 21 if hot else 200, 0, 0)


def test_conversations_share_a_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x", 1, "x"), ("b", 0, 2, "y", 2, "x"), ("c", 0, 3, "y", 2, "x")], "pair_id string, label int, ltable_id int, ltable_n string, rtable_id int, rtable_n string")
    store = AnswerStore(str(tmp_path / "said"))
    first = answers.SelfExplainer(lambda asked: asked.map(lambda c: "yes"), store=store)
    assert [r["prediction"] for r in first.predict(rows).collect()] == [1, 1, 1] and first.counts.distinct == 2
    second = answers.SelfExplainer(lambda asked: asked.map(lambda c: "no"), store=store)
    assert [r["prediction"] for r in second.predict(rows).collect()] == [1, 1, 1] and second.counts.known == second.counts.distinct
