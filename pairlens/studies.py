"""Queries of whole studies: explainers that ask, how results agree, what a saliency is worth; over whole driver tables.

The model behind the self-explainers is ``offline``, a plain rule that answers as models do: a pair matches if its sides share a third
of their words, an attribute matters as much as its values are alike, and the left record becomes the right one to turn the decision."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import alignment, metrics, parsing, text
from .operators import consistency, hybrid, lattice, matchers, pairs, support
from .operators.answers import SelfExplainer, judged
from .operators.calls import Counts
from .operators.pairs import L, R
from .plans import experiment
from .plans.explain import explain
from .queries import FEATURES, NAMES, _token_sets, decided, draws, explained, pair_list, r6, rows_of, sources
from .sources.io import train_test
from .written import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _shared(a: str, b: str) -> tuple[int, int]:
    x, y = set(a.lower().split(" ")), set(b.lower().split(" "))
    return len(x & y), len(x | y)


def offline(asked: pd.Series) -> pd.Series:
    """Answers to conversations, in the styles of models: bare, fenced, wrapped in words, unsure at first."""

    def one(conversation: str) -> str:
        messages = json.loads(conversation)
        question = next(m["content"] for m in reversed(messages) if m["content"].startswith("record1:"))
        first, second = question.split("record2:")
        if messages[-1]["role"] == "human":  # few-shot: quotes are taken out of the records
            return f"prediction:{int(len(first) % 2 == 0)}, saliency:{{'ltable_name': [0.5]}}, counterfactual:{{'ltable_name': 'x'}}"
        left, right = json.loads(first.split("record1:")[1]), json.loads(second)
        both, every = _shared(" ".join(left.values()), " ".join(right.values()))
        yes = 3 * both >= every
        like = {k: _shared(left[k], right[k]) for k in left}
        saliency = {f"ltable_{k}": a / b for k, (a, b) in like.items()} | {f"rtable_{k}": a / b / 2 for k, (a, b) in like.items()}
        last = messages[-1]["content"]
        if last.startswith("Answer") or "saliency_explanation" in messages[1]["content"]:
            told = {"same_entity": "Yes" if yes else "no", "saliency_explanation": saliency, "counterfactual_explanation": {"record1": right, "record2": right}}
            return f"Here it is.\n```json\n{json.dumps(told)}\n```"
        if last.startswith("Give the saliency"):
            return json.dumps({k: {"saliency": v} for k, v in saliency.items()})
        if last.startswith("Give both"):
            return "[/INST] So: " + str({"record_after": {f"ltable_{k}": v for k, v in right.items()}})
        if last.startswith("Why"):
            return "They share words."
        if last.startswith("Does that mean"):
            return "Yes" if yes else "No."
        return "Hard to tell" if every % 5 == 0 else "Yes." if yes else "no"

    return asked.map(one)


def longer(asked: pd.Series) -> pd.Series:
    """A judge that prefers the longer explanation."""

    def one(conversation: str) -> str:
        told = json.loads(conversation)[0]["content"].split("system1: ")[1].rsplit(" Which", 1)[0]
        a, b = told.split(" system2: ")
        return "I prefer system1." if len(a) > len(b) else "System2 is better." if len(b) > len(a) else "None."

    return asked.map(one)


_tried: set[str] = set()


def flaky(pdf: pd.DataFrame) -> pd.Series:
    """A service that fails on whole batches for the sake of some pairs, and on those at the first try."""
    told = [" ".join(map(str, r)) for r in pdf.itertuples(index=False)]
    bad = [t for t in told if zlib.crc32(t.encode()) % 29 == 0]
    if bad and (len(pdf) > 1 or bad[0] not in _tried):
        _tried.update(bad if len(pdf) == 1 else [])
        raise ConnectionError("no answer")
    return _token_sets(pdf)


def model() -> SelfExplainer:
    return SelfExplainer(offline)


def results(spark: SparkSession, d: str, *which: str) -> list[DataFrame]:
    """Result sets of the post-hoc explainer by attributes (certa) and by tokens (certa_token), and of the self-explainer (self)."""
    e = explained(spark, d)
    said = lambda: e.told(model().explain(e.distinct.rows).select("pair_id", "prediction", "saliency", "cf"))  # noqa: E731  what a model says follows from a pair's values too
    made = {"certa": lambda: experiment.post_hoc_results(e), "certa_token": lambda: experiment.post_hoc_results(e, "certa_token", tokens=True), "self": lambda: experiment.self_results(e.rows.join(said(), "pair_id"))}
    return [written(made[w]()) for w in which]


@query
def explain_any_matcher(spark, d):
    e = explain(pair_list(spark, d), *sources(spark, d), matcher=matchers.PandasMatcher(_token_sets))
    return e.saliency.withColumn("saliency", r6("saliency"))


@query
def flaky_matcher(spark, d):
    return matchers.PandasMatcher(flaky, wait=0.001).score(rows_of(spark, d)).select("pair_id", "match_score", "status")


@query
def matcher_counts(spark, d):
    """What two runs over one store ask: each pair and its mirror image, then all of these and each record with itself."""
    matcher = matchers.PandasMatcher(_token_sets, cache=f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")
    rows, out = pairs.robust(rows_of(spark, d)), []
    for run, kinds in enumerate((["pair", "mirror"], ["pair", "mirror", "left", "right"])):
        matcher.counts = Counts()
        some = rows.where(F.col("kind").isin(kinds))
        decided = matcher.decide(some, *matchers.sides(some), "decision").agg(F.sum("decision")).first()[0]
        out.append((run, matcher.counts.rows, matcher.counts.distinct, matcher.counts.known, matcher.counts.failed, decided))
    return spark.createDataFrame(out, "run int, asked long, questions long, known long, failed long, matches long")


@query
def explain_with_a_model(spark, d):
    e = explain(pair_list(spark, d), *sources(spark, d), augment="no", matcher=model())
    return e.support.select("pair_id", "side", "c_id", "ord", "decision")


@query
def self_explain(spark, d):
    out = model().explain(rows_of(spark, d))
    return out.select("pair_id", "prediction", F.explode("saliency").alias("feature", "score")).select("pair_id", "prediction", "feature", r6("score").alias("score"))


@query
def self_explain_turns(spark, d):
    out = experiment.original(model().explain_turns(rows_of(spark, d)))
    return out.select("pair_id", "prediction", F.size("saliency").alias("features"), F.array_join(alignment.changed_attributes(F.col("original"), F.col("cf")), ",").alias("changed"), F.size("conversation").alias("messages"))


@query
def few_shot_explain(spark, d):
    rows = rows_of(spark, d)
    examples = rows.orderBy("pair_id").limit(2).select(F.col("ltable_name").alias("ltuple"), F.col("rtable_name").alias("rtuple"), F.col("label").alias("prediction"), F.lit("{}").alias("saliency"), F.lit("{}").alias("cf"))
    out = model().explain_few_shot(rows, examples)
    return out.select("pair_id", F.element_at("saliency", "ltable_name").alias("score"), F.element_at("cf", "ltable_name").alias("changed"), F.size("conversation").alias("messages"))


@query
def result_concordance(spark, d):
    a, s = results(spark, d, "certa", "self")
    return alignment.concordance(a, s).select("id", "pred1", "pred2", "label", "agree", r6("kt").alias("kt"), r6("cos_sim").alias("cos_sim"))


@query
def concordance_pairs(spark, d):
    a, s = results(spark, d, "certa", "self")
    blank = s.withColumn("explainer", F.lit("zero")).withColumns({"prediction": F.lit(0), "cf": F.col("original")})
    out = alignment.all_concordances(a.unionByName(s).unionByName(blank))
    return out.select("a_explainer", "b_explainer", "n", *[r6(c).alias(c) for c in ("agreement", "first_right", "second_right", "kt", "cos_sim")])


@query
def faithfulness_scores(spark, d):
    a, t, s = results(spark, d, "certa", "certa_token", "self")
    return experiment.faithfulness(a.unionByName(t).unionByName(s), rows_of(spark, d), matchers.SqlMatcher()).withColumn("f1", r6("f1"))


@query
def faithfulness_auc(spark, d):
    a, t, s = results(spark, d, "certa", "certa_token", "self")
    points = experiment.faithfulness(a.unionByName(t).unionByName(s), rows_of(spark, d), matchers.SqlMatcher())
    return alignment.area_under(points, "explainer", "threshold", "f1").withColumn("auc", r6("auc"))


@query
def cf_metrics_average(spark, d):
    e = explained(spark, d)
    cfs = e.distinct.counterfactuals
    first = e.matcher.decide(cfs.where("place = 1"), [F.col(L + a) for a in NAMES], [F.col(R + a) for a in NAMES], NAMES, "new").select("pair_id", (1 - F.abs(F.col("new") - F.col("decision"))).alias("validity"))
    as_map = lambda p: F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(p + f) for f in FEATURES]))
    both = cfs.select("pair_id", *[F.col(f).alias(f"n_{f}") for f in FEATURES]).join(e.distinct.rows, "pair_id").select("pair_id", as_map("n_").alias("cf"), as_map("").alias("own"))
    proximity = both.select("pair_id", metrics.cf_distance(F.col("own"), F.col("cf"))[0].alias("p")).groupBy("pair_id").agg(F.avg("p").alias("proximity"))
    rows = first.join(proximity, "pair_id").join(metrics.diversity(cfs, "pair_id", FEATURES), "pair_id").withColumn("sparsity", 1 - F.col("proximity") / (len(FEATURES) / 2))
    return e.told(rows).agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("validity", "proximity", "sparsity", "diversity")])


@query
def attribute_token_overlap(spark, d):
    a, t = results(spark, d, "certa", "certa_token")
    return alignment.joined(t, a).select("id", r6(alignment.topk_attribute_overlap(F.col("a_saliency"), F.col("b_saliency"), 5, 3)).alias("overlap"))


@query
def saliency_consistency(spark, d):
    a, t = results(spark, d, "certa", "certa_token")
    of = lambda df: alignment.by_attribute(df).drop("explainer")
    out = alignment.saliency_consistency(of(t), of(a))
    return out.select("id", *[r6(c, 5).alias(c) for c in out.columns if c != "id"])


@query
def cf_change_alignment(spark, d):
    a, s = results(spark, d, "certa", "self")
    out = alignment.cf_alignment(s, a)
    return out.select("id", *[r6(c, 5).alias(c) for c in out.columns if c != "id"])


@query
def alignment_by_explainer(spark, d):
    a, t, s = results(spark, d, "certa", "certa_token", "self")
    tokens = t.withColumn("explainer", F.lit("certa")).drop("cf").join(s.select("id", "cf"), "id").select(a.columns)
    out = experiment.alignment_table(tokens, a, "rule")
    return out.select("model", "explainer", *[r6(c, 4).alias(c) for c in out.columns if c not in ("model", "explainer")])


@query
def saliency_cf_curve(spark, d):
    a, t = results(spark, d, "certa", "certa_token")
    seen = [alignment.saliency_on_cf(r).withColumn("explainer", F.lit(n)) for r, n in ((a, "certa"), (t, "certa_token"))]
    return seen[0].unionByName(seen[1]).groupBy("explainer", "k").agg(F.count("*").alias("n"), r6(F.avg("overlap"), 5).alias("overlap"), r6(F.avg("mass"), 5).alias("mass"))


def _ranked(r: DataFrame) -> DataFrame:
    return r.where("saliency is not null").select("explainer", F.col("id").alias("pair_id"), alignment.ranked_keys(F.col("saliency")).alias("names"))


@query
def attribute_consistency(spark, d):
    a, s = results(spark, d, "certa", "self")
    out = consistency.consistency(decided(spark, d), _ranked(a).unionByName(_ranked(s)), matchers.SqlMatcher())
    return out.select("explainer", "pair_id", "k", "decision", "new")


@query
def consistency_by_explainer(spark, d):
    a, s = results(spark, d, "certa", "self")
    seen = consistency.consistency(decided(spark, d), _ranked(a).unionByName(_ranked(s)), matchers.SqlMatcher())
    return consistency.by_explainer(seen).withColumn("consistency", r6("consistency"))


@query
def token_consistency(spark, d):
    (t,) = results(spark, d, "certa_token")
    return consistency.consistency(decided(spark, d), _ranked(t), matchers.SqlMatcher(), tokens=True)


@query
def judge_preferences(spark, d):
    a, s = results(spark, d, "certa", "self")
    both = alignment.joined(a, s).where("a_saliency is not null and b_saliency is not null").select(
        "id", F.to_json("a_original").alias("ltuple"), F.lit("").alias("rtuple"), F.col("a_prediction").alias("prediction"),
        F.array_join(F.slice(alignment.ranked_keys(F.col("a_saliency")), 1, 2), " ").alias("certa"), F.array_join(F.slice(alignment.ranked_keys(F.col("b_saliency")), 1, 2), " ").alias("self"),
    )
    return judged(both, "certa", "self", longer).groupBy("pick").agg(F.count("*").alias("n"))


@query
def changed_texts(spark, d):
    t = lambda p: text.tokens(*[F.col(p + a) for a in NAMES])
    rows = rows_of(spark, d)
    return rows.select(
        "pair_id", text.diff_label(F.col("ltable_name"), F.col("rtable_name")).alias("diff"), text.detokenised(text.tokenised(F.concat(F.lit("  "), F.col("ltable_name"), F.lit(" \t "), F.col("ltable_type")))).alias("again"),
        r6(text.anchor_distance(text.tokens(F.col("ltable_name")), t(L), t(R))).alias("distance"), r6(text.change_cosine(F.col("ltable_name"), F.col("rtable_name"), F.col("rtable_type"))).alias("cosine"),
    )


@query
def pair_copies(spark, d):
    return support.copies(rows_of(spark, d)).select("pair_id", "side", "c_id", *[f"c_{a}" for a in NAMES], "attribute", "position", "diff")


@query
def two_step_saliency(spark, d):
    return explained(spark, d).two_step().token_saliency.withColumn("saliency", r6("saliency"))


@query
def two_step_sufficient(spark, d):
    return explained(spark, d).two_step(by="sufficiency").token_saliency.withColumn("saliency", r6("saliency"))


@query
def token_sufficiency(spark, d):
    return explained(spark, d).token_sufficiency.select("pair_id", F.array_join("altered", "/").alias("altered"), r6("sufficiency").alias("sufficiency"))


@query
def monotone_traversal(spark, d):
    e = explained(spark, d)
    return e.told(lattice.monotone_flips(e.distinct.support, keep=written).select("pair_id", "triangle_id", "mask", "flip", "asked")).drop("pair_id")


@query
def full_set_flips(spark, d):
    e, n = explained(spark, d), len(NAMES)
    return e.told(lattice.flips(lattice.perturbed(e.distinct.support, NAMES, range(n, n + 1))).select("pair_id", "triangle_id", "mask", "flip")).drop("pair_id")


@query
def triangle_lattices(spark, d):
    e = explained(spark, d)
    return lattice.triangle_lattices(e.flips, e.support)


@query
def saliency_of_some(spark, d):
    e = explain(pair_list(spark, d), *sources(spark, d), vary=["name", "type", "size"])
    return e.saliency.withColumn("saliency", r6("saliency"))


@query
def hybrid_adaptive(spark, d):
    e = explained(spark, d)
    return hybrid.adaptive_explanation(draws(e), e.told(hybrid.sets_of(e.distinct.ranking.withColumnRenamed("flips", "flip"), NAMES)), NAMES).withColumn("saliency", r6("saliency"))


def self_draws(rows: DataFrame) -> DataFrame:
    """What two self-explainers say of each pair: one asks at once, one in turns."""
    m = model()
    parts = [m.explain(rows), m.explain_turns(rows)]
    return hybrid.collect([p.select(F.col("pair_id").alias("id"), "saliency") for p in parts])


@query
def hybrid_frontier(spark, d):
    e = explained(spark, d)  # what a model says follows from a pair's values too
    return e.told(hybrid.frontier(self_draws(e.distinct.rows), e.distinct.support, NAMES).saliency.withColumn("saliency", r6("saliency")))


@query
def hybrid_rounds(spark, d):
    """How many pairs are open at each width, and how many perturbed pairs are put to the matcher."""
    told = hybrid.frontier(self_draws(rows_of(spark, d)), explained(spark, d).support, NAMES).rounds
    return spark.createDataFrame(told, "k int, pairs long, asked long")


@query
def level_saliency(spark, d):
    e = explain(pair_list(spark, d), *sources(spark, d), strategy="levels")
    return e.saliency.withColumn("saliency", r6("saliency"))


@query
def level_steps(spark, d):
    e = explain(pair_list(spark, d), *sources(spark, d), strategy="levels")
    return e.token_steps.select("triangle_id", "path", "step", F.array_join("altered", "/").alias("altered"), "flip")


@query
def asked_by_strategy(spark, d):
    """What either strategy puts to the matcher, and the flips that it counts."""
    e = explained(spark, d)
    every, levels = e.distinct.flips, lattice.monotone_flips(e.distinct.support, keep=written)
    counts = lambda df: e.told(df.groupBy("pair_id").agg(F.sum("asked").alias("asked"), F.sum("flip").alias("flips")))
    parts = [counts(df).agg(F.sum("asked").cast("long").alias("asked"), F.sum("flips").alias("flips")).withColumn("strategy", F.lit(n)) for n, df in (("all", every), ("levels", levels))]
    return parts[0].unionByName(parts[1]).select("strategy", "asked", "flips")


@query
def hybrid_collected(spark, d):
    return hybrid.combine(self_draws(written(rows_of(spark, d))), 2, "freq")  # both explainers read the same rows


@query
def hybrid_random(spark, d):
    return hybrid.combine(draws(explained(spark, d)), 2, "random")


@query
def hybrid_token_features(spark, d):
    features = pairs.token_features(rows_of(spark, d)).select("pair_id", "feature")
    bare = rows_of(spark, d).select("pair_id", F.split("ltable_name", " ")[0].alias("token"))
    return hybrid.prefixed_tokens(bare, features)


@query
def feedback_prompts(spark, d):
    (a,) = results(spark, d, "certa")
    names = F.filter(alignment.ranked_keys(F.col("saliency")), lambda k: F.element_at("saliency", k) > 0)
    rows = a.join(rows_of(spark, d).select(F.col("pair_id").alias("id"), F.col("ltable_name").alias("l"), F.col("rtable_name").alias("r")), "id")
    return rows.select("id", parsing.feedback(F.col("l"), F.col("r"), names, F.col("prediction") == F.col("label")).alias("told"))


@query
def answers_read(spark, d):
    """Counterfactuals in the layouts that models use, marked answers, prompts to strip, predictions in words."""
    rows = rows_of(spark, d).select("pair_id", F.col("ltable_size").alias("a"), F.col("rtable_size").alias("b"), F.expr("ltable_id div 2 % 4").alias("i"))
    literal = lambda *parts: F.concat(*[F.lit(p) if p[0] != "$" else F.col(p[1:]) for p in parts])
    layouts = [
        literal("so {'record_after': {'ltable_size': '", "$b", "'}} there"), literal("```json\n{\"counterfactual\": {\"rtable_size\": \"", "$a", "\", \"x\": null}}\n```"),
        literal("{'record1': {'size': '", "$b", "', 'ok': True}, 'record2': {'rtable_size': '", "$b", "'}}"), literal("{\"ltable_size\": \"", "$b", "\", \"rtable_size\": \"", "$a", "\"}"),
    ]
    sides = {n: F.create_map(F.lit("size"), F.col(c)) for n, c in (("left", "a"), ("right", "b"))}
    rows = rows.withColumn("cf", parsing.parse_counterfactual(F.element_at(F.array(*layouts), (F.col("i") + 1).cast("int")), sides["left"], sides["right"]))
    marked = parsing.marked_parts(literal("prediction: ", "$a", ", saliency: {} counterfactual: ", "$b"))
    record = F.when(F.col("i") % 2 == 0, literal('{"answer": {"matching_prediction": "', "$a", '"}}')).otherwise(literal('{"prediction": "', "$a", '"}'))
    return rows.select(
        "pair_id", F.try_element_at("cf", F.lit("ltable_size")).alias("ltable_size"), F.try_element_at("cf", F.lit("rtable_size")).alias("rtable_size"), marked["counterfactual"].alias("marked"),
        parsing.result_parts(record)["prediction"].alias("told"), parsing.strip_prompt(literal("<s>[INST] ask [/INST]", "$b")).alias("stripped"),
        parsing.prediction_boolean(F.when(F.col("i") == 0, "Yes, they do").when(F.col("i") == 1, "true").when(F.col("i") == 2, "not yes").otherwise("no")).cast("int").alias("yes"),
    )


@query
def train_and_test(spark, d):
    return train_test(pair_list(spark, d)).groupBy("part", "label").agg(F.count("*").alias("n"))


@query
def robust_f1(spark, d):
    rows = pairs.robust(rows_of(spark, d)).withColumn("pair_id", F.lit("x"))
    scored = matchers.SqlMatcher().decide(rows, *matchers.sides(rows), "prediction")
    return matchers.f1(scored).withColumn("f1", r6("f1"))


@query
def example_pick(spark, d):
    """The first counterfactual of each pair with the fewest changed attributes named, as reports order them."""
    e = explained(spark, d)
    named = lattice.subset_name(F.col("side"), F.col("mask"), NAMES)
    order = Window.partitionBy("pair_id").orderBy(F.size(F.split("subset", "/")), "subset")
    return e.told(e.distinct.summary.select("pair_id", named.alias("subset")).withColumn("place", F.row_number().over(order)))
