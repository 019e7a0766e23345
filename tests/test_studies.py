"""Self-explainers, alignment, consistency and experiments: against SQL, brute force and hand-computed cases."""

import json
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens import queries, studies, studies_sql
from pairlens.functions import alignment, parsing, text
from pairlens.operators import answers, consistency, hybrid, lattice, matchers, pairs, support
from pairlens.plans import experiment
from pairlens.plans.explain import explain, with_cuts
from pairlens.sources import generate, io
from tests.test_engine import SF, TABLES

PAIR = "pair_id string, label int, ltable_id long, ltable_name string, ltable_size string, rtable_id long, rtable_name string, rtable_size string"


@pytest.mark.parametrize("name", ["flaky_matcher", "matcher_counts", "hybrid_frontier", "level_steps", "asked_by_strategy", "explain_with_a_model", "self_explain", "self_explain_turns", "result_concordance", "faithfulness_scores", "saliency_consistency", "cf_change_alignment", "two_step_saliency", "monotone_traversal", "hybrid_adaptive", "answers_read", "pair_copies", "attribute_consistency"])
def test_study_matches_sql(spark, name):
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as from '{SF}/{t}.parquet'")
    got, want = studies.QUERIES[name](spark, SF).toPandas(), duckdb.sql(studies_sql.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = lambda df: df.apply(lambda c: c.astype(float).round(6) + 0.0 if c.dtype.kind in "iuf" else c)
    shown = lambda df: sorted(map(str, numbers(df[sorted(df.columns)]).itertuples(index=False, name=None)))
    assert shown(got) == shown(want)


def test_every_study_but_one_has_sql():
    assert set(studies.QUERIES) - set(studies_sql.ORACLES) == {"token_consistency"} and not set(studies.QUERIES) & set(queries.QUERIES)


def brute_tokens(row, features, label):
    row = dict(row)
    for f in features:
        attribute, token = f.split("__", 1)
        other = ("rtable_" if attribute.startswith("l") else "ltable_") + attribute[7:]
        if not token:
            continue
        if label == 1:
            row[attribute] = re.sub(r"\s+", " ", re.sub(re.escape(token), "", row[attribute], flags=re.I)).strip()
        else:
            into = token if re.search(re.escape(token), row[other], re.I) else row[other]
            row[attribute] = re.sub(re.escape(token), lambda m: into, row[attribute], flags=re.I)
    return row


def test_token_changes_equal_plain_python(spark):
    data = [("a", 1, 1, "Red Bolt bolt (x)", "7", 2, "blue (X) $1 \\E", "7 8"), ("b", 0, 1, "Red Bolt", "7", 2, "red nut", "9"), ("c", 0, 3, "a+b c", "1", 4, "$2 z", "2")]
    features = {"a": ["ltable_name__BOLT", "ltable_name__(x)", "rtable_name__$1", "rtable_size__8"], "b": ["ltable_name__Red", "ltable_name__Bolt", "ltable_size__7"], "c": ["ltable_name__a+b", "rtable_size__2", "rtable_size__"]}
    rows = spark.createDataFrame(data, PAIR).withColumn("decision", F.col("label"))
    rows = rows.withColumn("f", F.element_at(F.create_map(*[x for k, v in features.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]), F.col("pair_id")))
    for r in consistency.change_tokens(rows, "f", "decision").collect():
        own = next(dict(zip([c.split()[0] for c in PAIR.split(", ")], d, strict=True)) for d in data if d[0] == r["pair_id"])
        want = brute_tokens({k: v for k, v in own.items() if k.endswith(("name", "size"))}, features[r["pair_id"]], own["label"])
        assert {k: r[k] for k in want} == want


def test_tokens_with_slashes_stay_whole(spark):
    left = spark.createDataFrame([(1, "open 24/7 shop")], "id long, name string")
    right = spark.createDataFrame([(1, "open 24/7 shop"), (2, "closed all day")], "id long, name string")
    e = explain(spark.createDataFrame([(1, 1, 1)], "ltable_id long, rtable_id long, label int"), left, right)
    names = {r["feature"] for r in e.token_saliency.collect()}
    assert "rtable_name__24/7" in names and "7" not in names


def test_any_matcher_explains_and_is_asked_once(spark, tmp_path):
    left, right, truth = generate.sources(spark, 30, 3, 10, 10)
    told = str(tmp_path / "asked")

    def rule(pdf):
        pdf.to_csv(f"{told}-{abs(hash(tuple(map(tuple, pdf.to_numpy()))))}.csv", index=False)
        return pd.Series([float(a.split(" ")[0] == b.split(" ")[0]) for a, b in zip(pdf["ltable_attribute_1"], pdf["rtable_attribute_1"], strict=True)], index=pdf.index)

    matcher = matchers.PandasMatcher(rule, cache=str(tmp_path / "cache"))
    sql = matchers.SqlMatcher(lambda a, b: (F.split(a[0], " ")[0] == F.split(b[0], " ")[0]).cast("int"))
    got, want = (explain(truth, left, right, matcher=m).saliency.orderBy("pair_id", "feature").collect() for m in (matcher, sql))
    assert got == want and got
    cached = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "cache"))
    assert cached.count() == cached.dropDuplicates(["key"]).count() == matcher.counts.distinct - matcher.counts.known
    asked = len(list(tmp_path.glob("asked-*")))
    explain(truth, left, right, matcher=matcher).saliency.collect()
    assert len(list(tmp_path.glob("asked-*"))) == asked  # all known by now


def test_augmentation_modes(spark):
    left = spark.createDataFrame([(1, "red steel bolt"), (2, "blue nut")], "id long, name string")
    right = spark.createDataFrame([(1, "green wool sock"), (2, "odd thing")], "id long, name string")
    pair = spark.createDataFrame([(1, 1, 0)], "ltable_id long, rtable_id long, label int")
    none, some, every = (explain(pair, left, right, augment=a).support.count() for a in ("no", "on_demand", "always"))
    assert none == 0 and some == 4 and every == 0  # two words of three match, one does not; cuts of other records don't match either
    assert with_cuts(left, ["name"]).where("id < 0").count() == 6
    with pytest.raises(ValueError, match="augment"):
        explain(pair, left, right, augment="sometimes")


def test_lookup_finds_nulls_and_near_records(spark):
    records = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", "z"), (3, "a", "x", "z"), (4, "b", "q", None)], "id long, n string, m string, o string")
    asked = spark.createDataFrame([(10, "a", "x", "z"), (11, "a", "y", "z"), (12, "b", "q", None), (13, "c", None, None)], "query_id long, n string, m string, o string")
    got = {r["query_id"]: (r["id"], r["same"]) for r in pairs.lookup(asked, records, ["n", "m", "o"]).collect()}
    assert got == {10: (2, 3), 11: (2, 2), 12: (4, 2)}


def test_merge_takes_the_least_of_repeated_ids(spark):
    left = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "id long, name string")
    out = pairs.merge(spark.createDataFrame([(1, 1, 1)], "ltable_id long, rtable_id long, label int"), left, left).collect()
    assert [(r["ltable_name"], r["rtable_name"]) for r in out] == [("a", "a")]


def test_counterfactual_layouts(spark):
    raw = ["{'record_after': {'rtable_a': 'x'}}", '{"counterfactual_record": {"ltable_a": "y"}}', "text {'record1': {'a': 'p'}, 'record2': {'rtable_a': None}} text", '{"ltable_a": "q"}', "nothing", None]
    df = spark.createDataFrame([(r,) for r in raw], "t string").select(parsing.parse_counterfactual(F.col("t"), F.create_map(F.lit("a"), F.lit("l")), F.create_map(F.lit("a"), F.lit("r"))).alias("m"))
    assert [r["m"] for r in df.collect()] == [{"rtable_a": "x", "ltable_a": "l"}, {"ltable_a": "y"}, {"ltable_a": "p", "rtable_a": None}, {"ltable_a": "q"}, None, None]


def test_models_that_fail_or_doubt(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x", "1", 1, "x", "1")], PAIR)

    def fails(asked):
        raise RuntimeError("no service")

    assert answers.SelfExplainer(fails).predict(rows).first()["prediction"] == 0
    doubt = answers.SelfExplainer(lambda asked: asked.map(lambda c: "yes" if "Does that mean" in c else "well"))
    out = doubt.predict(rows).first()
    assert out["prediction"] == 1 and [m["content"] for m in out["conversation"]][-2:] == ["Does that mean yes or no?", "yes"]
    assert out["tokens"] == sum(len(m["content"].split(" ")) for m in out["conversation"])
    few = answers.SelfExplainer(lambda asked: asked.map(lambda c: "prediction: 1, saliency: {'ltable_name': [0.25], 'x': 'bad'} counterfactual: {'ltable_name': 'z'}"))
    examples = spark.createDataFrame([("l", "r", "1", "{}", "{}")], "ltuple string, rtuple string, prediction string, saliency string, cf string")
    got = few.explain_few_shot(rows, examples).first()
    assert (got["prediction"], got["saliency"], got["cf"]) == (1, {"ltable_name": 0.25, "x": None}, {"ltable_name": "z"})


def test_judge_picks_by_content_not_by_place(spark):
    both = spark.createDataFrame([(i, "l", "r", 1, "long " * (1 + i % 3), "long " * 2) for i in range(30)], "id long, ltuple string, rtuple string, prediction int, a string, b string")
    picks = {r["id"]: r["pick"] for r in answers.judged(both, "a", "b", studies.longer).collect()}
    assert picks == {i: {0: "b", 1: "none", 2: "a"}[i % 3] for i in range(30)}


def test_experiments_and_sinks(spark, tmp_path):
    left, right, truth = generate.sources(spark, 20, 2, 5, 10)
    rows = pairs.merge(truth, left, right)
    model = answers.SelfExplainer(lambda asked: asked.map(lambda c: json.dumps({"same_entity": "yes", "saliency_explanation": {"ltable_attribute_1": 0.5}, "counterfactual_explanation": {"ltable_attribute_1": "q"}}) if "saliency_explanation" in c else "yes"))
    told = experiment.evaluate({"self": lambda: experiment.self_results(model.explain(rows))}, str(tmp_path / "out"))
    assert told["self"]["rows"] == rows.count() and 0 < told["self"]["f1"] <= 1 and list((tmp_path / "out" / "self").glob("*.json"))
    f1s = experiment.actionable(model, model.explain(rows), rows).first()
    assert f1s["baseline"] == f1s["enhanced"] == pytest.approx(told["self"]["f1"])
    io.write_csv(rows.withColumn("list", F.array("pair_id")), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == rows.count() and json.loads(back.first()["list"])[0].startswith("0@")
    offers = [spark.createDataFrame([(i, "a", i + 10, "b", 1)], "id_left long, title_left string, id_right long, title_right string, label int") for i in (1, 1, 2)]
    a, b, lists = io.offer_splits(offers, ["title"])
    assert (a.count(), b.count(), len(lists)) == (2, 2, 3)


def test_generator_keeps_matches_alike(spark):
    left, right, truth = generate.sources(spark, 150, 105, 150, 200)
    assert (left.count(), right.count(), len(left.columns)) == (300, 300, 106) and {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()} == {1: 150, 0: 200}
    long = spark.createDataFrame([(1, "word " * 3000 + "street")], "id long, v string").select("v", generate.noisy(F.col("v"), F.col("id"), "s", 0).alias("n")).first()
    assert sorted(long["n"].split(" ")) == sorted(long["v"].split(" "))
    score = pairs.merge(truth, *(s.select("id", "attribute_1", "attribute_2", "attribute_3") for s in (left, right))).withColumns({f"_{p}": text.tokens(*[F.col(f"{p}table_attribute_{i}") for i in (1, 2, 3)]) for p in "lr"})
    mean = {r["label"]: r["m"] for r in score.groupBy("label").agg(F.avg(text.jaccard(F.col("_l"), F.col("_r"))).alias("m")).collect()}
    assert mean[1] > mean[0] + 0.05


def test_small_alignment_cases(spark):
    df = spark.createDataFrame([({"ltable_a": "x y", "rtable_a": "p"}, {"ltable_a": "x z", "rtable_a": "p"}, {"ltable_a": 0.75, "rtable_a": 0.25})], "original map<string,string>, cf map<string,string>, saliency map<string,double>")
    r = df.select(alignment.changed_tokens(F.col("original"), F.col("cf")).alias("t"), alignment.changed_attributes(F.col("original"), F.col("cf")).alias("a"), alignment.ranked_keys(F.col("saliency"), F.lit(True)).alias("up")).first()
    assert r["t"] == ["ltable_a__y", "ltable_a__z"] and r["a"] == ["ltable_a"] and r["up"] == ["rtable_a", "ltable_a"]
    curve = {x["k"]: (x["overlap"], x["mass"]) for x in alignment.saliency_on_cf(df.withColumn("id", F.lit(1)), (1, 2)).collect()}
    assert curve == {1: (1.0, 0.75), 2: (1.0, 0.75)}
    assert lattice.hasse_dot(["a", "b"]).count("->") == 4
    assert support.copies(spark.createDataFrame([("p", 1, 1, "a b", "1", 2, "c", "2")], PAIR)).select("side", "c_name", "diff").orderBy("c_name").collect() == [("R", "a", "-b"), ("R", "b", "-a")]
    d = hybrid.collect([spark.createDataFrame([("p", {"f": 0.5})], "id string, saliency map<string,double>")] * 2)
    assert d.count() == 2
