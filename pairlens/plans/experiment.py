"""Whole experiments: explainers over pairs, their results and scores."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment, parsing
from ..operators.answers import SelfExplainer
from ..operators.matchers import Matcher, f1, sides
from ..operators.pairs import L, R, attributes, tuple_of
from ..sources.io import write_results
from .explain import Explanation

RESULT = ("explainer", "id", "prediction", "label", "saliency", "cf", "original")


def original(rows: DataFrame) -> DataFrame:
    """Pair rows with ``original``: the map of all prefixed attributes."""
    names = [p + a for p in (L, R) for a in attributes(rows)]
    return rows.withColumn("original", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])))


def post_hoc_results(e: Explanation, name: str = "certa", tokens: bool = False) -> DataFrame:
    """An explanation as result rows: each pair with its saliency and first counterfactual."""
    names = [p + a for p in (L, R) for a in e.names]
    d = e.distinct
    saliency = (d.token_saliency if tokens else d.saliency).groupBy("pair_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "saliency")))).alias("saliency"))
    cf = d.first_counterfactuals.select("pair_id", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])).alias("cf"))
    decided = d.matcher.decide(d.rows, *sides(d.rows), "prediction").select("pair_id", "prediction")
    out = original(e.rows).join(e.told(decided.join(saliency, "pair_id", "left").join(cf, "pair_id", "left")), "pair_id")
    return out.select(F.lit(name).alias("explainer"), F.col("pair_id").alias("id"), "prediction", "label", "saliency", "cf", "original")


def self_results(explained: DataFrame, name: str = "self") -> DataFrame:
    """Pair rows that a SelfExplainer has explained, as result rows."""
    return original(explained).select(F.lit(name).alias("explainer"), F.col("pair_id").alias("id"), "prediction", "label", "saliency", "cf", "original")


def evaluate(explainers: dict[str, Callable[[], DataFrame]], out: str) -> dict[str, dict]:
    """Runs each explainer, writes its results as JSON under ``out``/<name>, and returns its seconds, rows and F1."""
    told = {}
    for name, run in explainers.items():
        began = time.time()
        results = run().persist()
        write_results(results.withColumn("saliency", F.to_json("saliency")).withColumn("cf", F.to_json("cf")).withColumn("original", F.to_json("original")), f"{out}/{name}")
        n, score = results.count(), f1(results).first()["f1"]
        results.unpersist()
        seconds = time.time() - began
        told[name] = {"total_time": seconds, "rows": n, "avg_latency": seconds / max(1, n), "f1": score}
    return told


def actionable(explainer: SelfExplainer, explained: DataFrame, rows: DataFrame, n_examples: int = 10) -> DataFrame:
    """One row, baseline and enhanced: F1 of plain predictions, and of predictions after feedback from explained pairs (pair rows with
    prediction and saliency), the first wrong one ending the examples."""
    names = attributes(rows)
    ranked = F.filter(alignment.ranked_keys(F.col("saliency")), lambda k: F.element_at("saliency", k) > 0)
    told = explained.where("saliency is not null").select("pair_id", "label", "prediction", parsing.feedback(F.to_json(tuple_of(L, names)), F.to_json(tuple_of(R, names)), ranked, F.col("prediction") == F.col("label"), explainer.granularity).alias("t"))
    shown = []
    for r in told.orderBy("pair_id").limit(n_examples).collect():  # the examples of a prompt
        shown.append(r["t"])
        if r["prediction"] != r["label"]:
            break
    more = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")) for t in shown for role, text in (("user", t), ("assistant", "ok"))])
    base, better = (f1(explainer.predict(rows, m)).select(F.col("f1").alias(n)) for m, n in ((None, "baseline"), (more if shown else None, "enhanced")))
    return base.crossJoin(better)  # one row each


def faithfulness(results: DataFrame, rows: DataFrame, matcher: Matcher, n_columns: int | None = None) -> DataFrame:
    """explainer, threshold, f1 of the matcher on pair rows without each explainer's top features."""
    names = [p + a for p in (L, R) for a in attributes(rows)]
    top = alignment.top_features(results, n_columns or len(names) + 1)
    masked = alignment.without_features(rows.join(top.withColumnRenamed("id", "pair_id"), "pair_id"), "features", names)
    decided = matcher.decide(masked, *sides(masked), "p")
    n = lambda c: F.sum(c.cast("long"))
    y, q = F.col("label"), F.col("p")
    sums = decided.groupBy("explainer", "threshold").agg(n((y == 1) & (q == 1)).alias("tp"), n((y == 0) & (q == 1)).alias("fp"), n((y == 1) & (q == 0)).alias("fn"))
    return sums.select("explainer", "threshold", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def alignment_table(token_results: DataFrame, attribute_results: DataFrame, model: str, k_tokens: int = 30, k_attributes: int = 3) -> DataFrame:
    """One row of averages for each explainer that has results of both granularities: how token and attribute results agree."""
    names = [r[0] for r in token_results.select("explainer").distinct().intersect(attribute_results.select("explainer").distinct()).collect()]  # a few explainers
    parts = []
    for name in sorted(names):
        t, a = token_results.where(F.col("explainer") == name), attribute_results.where(F.col("explainer") == name)
        of = lambda df: alignment.by_attribute(df).drop("explainer")
        seen = alignment.saliency_consistency(of(t), of(a)).join(alignment.joined(t, a).select("id", alignment.topk_attribute_overlap(F.col("a_saliency"), F.col("b_saliency"), k_tokens, k_attributes).alias("topk_overlap")), "id")
        first = seen.agg(*[F.avg(c).alias(f"avg_{c}") for c in seen.columns if c != "id"])
        cfs = alignment.cf_alignment(t, a, k_attributes)
        second = cfs.agg(*[F.avg(c).alias(f"avg_{c}") for c in cfs.columns if c != "id"])
        parts.append(first.crossJoin(second).select(F.lit(model).alias("model"), F.lit(name).alias("explainer"), "*"))  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
