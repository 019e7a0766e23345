"""What asking costs: how often rows are put to a function, and what their tables send through the shuffle."""

import json
import zlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from pairlens import studies, studies_sql
from pairlens.operators import answers, calls, matchers
from pairlens.operators.calls import Caller, Counts
from tests.test_engine import SF


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_that_fail_are_found_without_asking_all_at_every_width():
    asked, tried = [], set()
    bad = {i for i in range(1000) if zlib.crc32(str(i).encode()) % 29 == 0}

    def late(pdf):
        asked.append(len(pdf))
        found = bad & set(pdf["q"])
        if found and (len(pdf) > 1 or not found <= tried):
            tried.update(found if len(pdf) == 1 else ())
            raise ConnectionError
        return pdf["q"] * 2

    got, status = calls.answered(pd.DataFrame({"q": range(1000)}), late, wait=0)
    assert got == [2 * i for i in range(1000)] and set(status) == {"ok"} and tried == bad
    assert sum(asked) < 6000 and len(asked) < 380

    def never(pdf):
        asked.append(len(pdf))
        if bad & set(pdf["q"]):
            raise ConnectionError
        return pdf["q"] * 2

    got, status = calls.answered(pd.DataFrame({"q": range(1000)}), never, wait=0)
    assert got == [None if i in bad else 2 * i for i in range(1000)]
    assert {i for i, s in enumerate(status) if s == "failed: ConnectionError"} == bad and status.count("ok") == 1000 - len(bad)


def test_a_batch_that_fails_for_no_row_is_answered():
    asked = []

    def once(pdf):
        asked.append(len(pdf))
        if len(asked) == 1:
            raise TimeoutError
        return pdf["q"]

    got, status = calls.answered(pd.DataFrame({"q": range(100)}), once, wait=0)
    assert got == [*range(100)] and set(status) == {"ok"}


def test_a_service_that_takes_few_rows_is_not_asked_for_many_again_and_again():
    asked = []

    def few(pdf):
        asked.append(len(pdf))
        if len(pdf) > 70:
            raise ValueError
        return pdf["q"]

    got, status = calls.answered(pd.DataFrame({"q": range(1000)}), few, wait=0)
    assert got == [*range(1000)] and set(status) == {"ok"} and sum(n > 70 for n in asked) == 4 and len(asked) < 31


def test_rows_to_ask_are_computed_once_and_meet_their_answers_once(spark):
    made = spark.range(300).groupBy((F.col("id") % 100).alias("pair_id")).agg(F.max("id").cast("string").alias("ltable_x"), F.min("id").cast("string").alias("rtable_x"))
    out = matchers.PandasMatcher(lambda pdf: (pdf["ltable_x"] > pdf["rtable_x"]).astype(float)).score(made)
    assert exchanges(out) == 2  # one for the rows, one for the answers
    assert out.count() == 100


def test_odd_rows_are_asked_as_they_are(spark):
    data = [(1, None, 1), (2, "", 1), (3, None, 1), (4, "a", None), (5, "a", None), (5, "a", None), (6, "a", 0), (7, "bad", 1)]

    def call(pdf):
        if (pdf["a.b"] == "bad").any():
            raise RuntimeError
        return pd.Series(["none" if x is None else f"<{x}>" for x in pdf["a.b"]])

    rows = spark.createDataFrame(data, "id int, `a.b` string, n int")
    caller = Caller(call, wait=0)
    out = caller(rows, ["a.b", "n"])
    assert out.columns == ["id", "a.b", "n", "_answer", "_status"]
    got = sorted((r["id"], r["_answer"], r["_status"]) for r in out.collect())
    assert got == [(1, "none", "ok"), (2, "<>", "ok"), (3, "none", "ok"), (4, "<a>", "ok"), (5, "<a>", "ok"), (5, "<a>", "ok"), (6, "<a>", "ok"), (7, None, "failed: RuntimeError")]
    assert caller.counts == Counts(8, 5, 0, 1)
    none = Caller(call, wait=0)
    assert none(rows.where("id > 9"), ["a.b", "n"]).count() == 0 and none.counts == Counts()


PAIR = "pair_id string, label int, ltable_id long, ltable_name string, ltable_size string, rtable_id long, rtable_name string, rtable_size string"
ODD = [("a", 1, 1, "red bolt", "7", 2, "red bolt", "7"), ("a", 1, 1, "red bolt", "7", 2, "red bolt", "7"), ("b", 0, 3, "red bolt", "7", 4, "red bolt", "7"), ("c", 0, 5, None, "1", 6, "", None), (None, None, None, None, None, None, "nan", "x y z"), ("d", 0, 7, "", None, 8, "{rtuple}", "a b")]


def test_turns_lead_equal_conversations_once_and_join_them_once(spark):
    rows = spark.createDataFrame(ODD, PAIR)
    seen = spark.sparkContext.accumulator(0)

    def counted(asked):
        seen.add(len(asked))
        return studies.offline(asked)

    model = answers.SelfExplainer(counted)
    out = model.explain_turns(rows)
    assert exchanges(out) == 2  # one for the rows, one for the conversations
    assert out.columns == [*rows.columns, "conversation", "prediction", "why", "saliency", "cf", "tokens"]
    got = out.collect()
    assert sorted(str(r[:8]) for r in got) == sorted(map(str, ODD))
    again = sum(len(r["conversation"]) == 13 for r in got)
    assert model.counts.rows == 4 * len(ODD) + again and model.counts.distinct == seen.value < model.counts.rows
    for r in got:
        asked = [{"role": m["role"], "content": m["content"]} for m in r["conversation"]]
        for i, m in enumerate(asked):
            if i > 3 and m["role"] == "assistant":
                assert m["content"] == studies.offline(pd.Series([json.dumps(asked[:i])])).iloc[0]
        told = json.loads(asked[-3]["content"])
        assert r["saliency"] == {k: v["saliency"] for k, v in told.items()} and r["why"] == "They share words."
        assert r["tokens"] == sum(len(m["content"].split(" ")) for m in asked)
    assert [m["content"] for m in got[0]["conversation"]][-2].startswith("Give both records") and model.explain_turns(rows.where("label > 9")).count() == 0


def test_what_rows_hold_already_is_replaced_where_it_stands(spark):
    rows = spark.createDataFrame(ODD, PAIR).select(F.lit("old").alias("conversation"), "*", F.lit(7).alias("prediction"))
    out = answers.SelfExplainer(studies.offline).predict(rows)
    assert out.columns == [*rows.columns, "tokens"]
    assert {r["prediction"] for r in out.collect()} <= {0, 1} and {len(r["conversation"]) for r in out.collect()} <= {5, 7}


def test_turns_share_a_store(spark, tmp_path):
    rows, store = spark.createDataFrame(ODD, PAIR), calls.AnswerStore(str(tmp_path / "said"))
    first, second = (answers.SelfExplainer(f, store=store) for f in (studies.offline, lambda asked: asked.map(lambda c: "no")))
    shown = lambda out: sorted(str(r.asDict(recursive=True)) for r in out.collect())
    assert shown(first.explain_turns(rows)) == shown(second.explain_turns(rows))
    assert second.counts.known == second.counts.distinct == first.counts.distinct and second.counts.rows == first.counts.rows


def test_pair_rows_are_built_once_for_both_explainers(spark, monkeypatch):
    read = []
    for name in ("explain", "explain_turns"):
        monkeypatch.setattr(studies.SelfExplainer, name, lambda self, rows, f=getattr(studies.SelfExplainer, name): read.append(sorted(rows.inputFiles())) or f(self, rows))
    got = studies.hybrid_collected(spark, SF).collect()
    assert read[0] == read[1] and not any("part.parquet" in at for at in read[0])
    duckdb.sql(f"create or replace view part as from '{SF}/part.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(f"select pair_id, feature, place from ({studies_sql.ORACLES['hybrid_collected']})").fetchall())
