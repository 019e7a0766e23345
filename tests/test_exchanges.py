"""What large tables send through the shuffle or keep on disk: results of a pair are made where its supports lie."""

import os

import pytest
from pyspark.sql import functions as F

from pairlens import queries
from pairlens.operators import calls, hybrid
from pairlens.plans import experiment
from pairlens.plans.explain import Explanation, explain
from pairlens.written import shared_dir
from tests.test_engine import SF


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def tables(spark):
    return set(os.listdir(shared_dir(spark)))


@pytest.fixture(scope="module")
def e(spark):
    out = queries.explained(spark, SF).distinct
    assert out.support.count()
    return out


def test_token_steps_are_made_where_supports_lie(spark, e):
    before = tables(spark)
    assert exchanges(e.token_saliency) == exchanges(e.token_steps) == 1
    assert tables(spark) == before
    two = e.two_step()
    assert len(tables(spark) - before) == 2  # the ranking and the tokens to vary
    assert exchanges(two.token_saliency) <= 3


def test_levels_of_a_rule_are_ended_in_one_plan(spark):
    e = explain(queries.pair_list(spark, SF), *queries.sources(spark, SF), strategy="levels").distinct
    assert e.support.count()
    before = tables(spark)
    whole, ended = Explanation(e.rows, e.found, e.names), e.token_steps
    whole.support = e.support
    assert tables(spark) == before
    rows, last = {}, {}
    for r in whole.token_steps.collect():
        rows.setdefault(r["pair_id"], []).append(r)
    for pair, own in rows.items():
        last[pair] = min((s for s in {r["step"] for r in own} if all(r["flip"] for r in own if r["step"] == s)), default=10**9)
    want = [r for own in rows.values() for r in own if r["step"] <= last[r["pair_id"]]]
    assert sorted(map(str, ended.collect())) == sorted(map(str, want)) and len(want) < sum(map(len, rows.values()))


@pytest.mark.parametrize("name", ["noise_f1"])
def test_sources_are_not_sent_through_the_driver(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_widths_are_weighed_in_a_row_for_each_pair(spark, e):
    """A row for each subset and width, and a plan for each width, made hybrid_adaptive long."""
    draws = queries.draws(e)
    sets = hybrid.sets_of(e.ranking.withColumnRenamed("flips", "flip"), e.names)
    assert sets.count() == e.ranking.select("pair_id").distinct().count()
    plan = hybrid.adaptive_explanation(draws, sets, e.names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Union" not in plan.split("Scan parquet")[0]


def test_first_counterfactuals_are_found_once(spark, e):
    experiment.post_hoc_results(e)
    before = tables(spark)
    token = experiment.post_hoc_results(e, "certa_token", tokens=True)
    assert tables(spark) == before
    want = {r["pair_id"]: tuple(r[f] for f in queries.FEATURES) for r in e.counterfactuals.where("place = 1").collect()}
    got = {r["id"]: tuple(r["cf"][f] for f in queries.FEATURES) for r in token.where("cf is not null").collect()}
    assert got == want and exchanges(token) < 10


def test_answers_are_not_sent_through_the_driver(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("q"))
    few = rows.select("q", F.lit(1).cast("long").alias("n"))
    out = calls.spread(rows, few, "q", "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan  # hot questions may be broadcast
    assert out.count() == 1000
