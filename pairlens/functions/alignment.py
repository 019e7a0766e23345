"""How results of explainers agree: with each other, between granularities, and with their own counterfactuals.

A result is a row (explainer, id, prediction, label, saliency map<string,double>, cf map<string,string>, original map<string,string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .text import change_cosine, count_cosine, tokenised, words

THRESHOLDS = (0.1, 0.33, 0.5, 0.7, 0.9)


def ranked_keys(saliency: Column, ascending: Column | None = None) -> Column:
    """Features by descending score (ascending, where that holds), then name."""
    sign = F.lit(-1.0) if ascending is None else F.when(ascending, 1.0).otherwise(-1.0)
    return F.transform(F.array_sort(F.transform(F.map_entries(saliency), lambda x: F.named_struct(F.lit("s"), sign * x["value"], F.lit("k"), x["key"]))), lambda x: x["k"])


def attribute_of(feature: Column) -> Column:
    return F.substring_index(feature, "__", 1)


def by_attribute(results: DataFrame) -> DataFrame:
    """explainer, id, feature, mass: saliency summed by attribute, so that token and attribute results compare."""
    rows = results.select("explainer", "id", F.explode("saliency").alias("k", "v"))
    return rows.groupBy("explainer", "id", attribute_of(F.col("k")).alias("feature")).agg(F.sum("v").alias("mass"))


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two result sets by id, as a_<column> and b_<column>; ids that only one has go."""
    named = lambda df, p: df.select("id", *[F.col(c).alias(p + c) for c in df.columns if c != "id"])
    return named(a, "a_").join(named(b, "b_"), "id")


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, pred1, pred2, label, agree, kt, cos_sim; the last two are null where one result has no saliency or counterfactual."""
    both = joined(a, b).where("a_prediction is not null and b_prediction is not null")
    both = both.withColumns({"_a": ranked_keys(F.col("a_saliency")), "_b": ranked_keys(F.col("b_saliency"))})
    both = both.withColumns({f"_{s}w": words(F.concat_ws(" ", F.map_values(f"{s}_cf")), lower=False) for s in "ab"})
    cosine = F.when(F.col("a_cf").isNotNull() & F.col("b_cf").isNotNull(), count_cosine(F.col("_aw"), F.col("_bw")))
    return both.select(
        "a_explainer", "b_explainer", "id", F.col("a_prediction").alias("pred1"), F.col("b_prediction").alias("pred2"), F.col("a_label").alias("label"),
        (F.col("a_prediction") == F.col("b_prediction")).cast("int").alias("agree"), metrics.kendall(F.col("_a"), F.col("_b")).alias("kt"), cosine.alias("cos_sim"),
    )


def all_concordances(results: DataFrame) -> DataFrame:
    """A row for each two explainers: how often they agree with each other and with the label, and mean tau and cosine."""
    rows = results.alias("x").join(results.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.explainer") < F.col("y.explainer")))
    side = lambda s: rows.select(F.concat_ws("|", "x.explainer", "y.explainer", "x.id").alias("id"), *[F.col(f"{s}.{c}").alias(c) for c in results.columns if c != "id"])
    seen = concordance(side("x"), side("y"))
    equal = lambda a, b: F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int"))
    return seen.groupBy("a_explainer", "b_explainer").agg(F.count("*").alias("n"), equal("pred1", "pred2").alias("agreement"), equal("pred1", "label").alias("first_right"), equal("pred2", "label").alias("second_right"), F.avg("kt").alias("kt"), F.avg("cos_sim").alias("cos_sim"))


def topk_attribute_overlap(token_map: Column, attribute_map: Column, k_tokens: int = 30, k_attributes: int = 3) -> Column:
    """Of the top attributes, the share to which some top token belongs; 0 without any."""
    of_tokens = F.array_distinct(F.transform(F.slice(ranked_keys(token_map), 1, k_tokens), attribute_of))
    top = F.slice(ranked_keys(attribute_map), 1, k_attributes)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(top, of_tokens)), F.size(top)), F.lit(0.0))


def saliency_consistency(tokens: DataFrame, attributes: DataFrame) -> DataFrame:
    """id, mass, tau, pearson, spearman, overlap, cosine of two saliencies summed by attribute: (id, feature, mass) each.

    Shares of the whole are compared attribute by attribute, 0 where one has none.  Overlap is the mean over k = 2, 4, ... below the
    number of attributes of the share of common ones among the k first.  All are 0 where one saliency is nothing; correlations are 0
    where one doesn't vary."""
    pair = Window.partitionBy("id")
    x, y = (df.select("id", "feature", F.col("mass").alias(n)) for df, n in ((tokens, "x"), (attributes, "y")))
    rows = y.join(x, ["id", "feature"], "full").fillna(0.0, ["x", "y"])
    total = lambda c: F.sum(c).over(pair)
    rows = rows.withColumns({"x": F.coalesce(F.try_divide("x", total("x")), F.lit(0.0)), "y": F.coalesce(F.try_divide("y", total("y")), F.lit(0.0))})
    order = lambda c: pair.orderBy(F.desc(c), "feature")
    ties = lambda c: Window.partitionBy("id", c)
    rows = rows.withColumns({"px": F.row_number().over(order("x")), "py": F.row_number().over(order("y")), "n": F.count("*").over(pair)})
    rows = rows.withColumns({"rx": F.avg("px").over(ties("x")), "ry": F.avg("py").over(ties("y")), "m": F.greatest("px", "py")})

    def corr(a: str, b: str) -> Column:
        n, mean = F.count("*"), lambda c: F.sum(c)
        cov = n * F.sum(F.col(a) * F.col(b)) - mean(a) * mean(b)
        var = lambda c: n * F.sum(F.col(c) * F.col(c)) - mean(c) * mean(c)
        whole = var(a) * var(b)
        return F.when(whole > 1e-15, cov / F.sqrt(F.when(whole > 1e-15, whole)))

    ks = F.filter(F.sequence(F.lit(2), F.greatest(F.col("n").cast("int"), F.lit(2)), F.lit(2)), lambda k: k < F.col("n"))
    share = F.aggregate(ks, F.lit(0.0), lambda s, k: s + F.when(F.col("m") <= k, 1.0 / k).otherwise(0.0)) / F.greatest(F.size(ks), F.lit(1))
    lists = [F.transform(F.array_sort(F.collect_list(F.struct(p, "feature"))), lambda z: z["feature"]).alias(n) for p, n in (("px", "names_x"), ("py", "names_y"))]
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = rows.withColumn("share", share).groupBy("id").agg(
        F.sum(F.least("x", "y")).alias("mass"), corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"), F.sum("share").alias("overlap"),
        F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))).alias("cosine"), (F.least(F.sum("x"), F.sum("y")) > 0).alias("some"), *lists,
    )
    sums = sums.withColumn("tau", metrics.kendall(F.col("names_x"), F.col("names_y")))
    return sums.select("id", *[F.when(F.col("some"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c) for c in ("mass", "tau", "pearson", "spearman", "overlap", "cosine")])


def changed_attributes(original: Column, cf: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(original), lambda k: ~F.element_at(original, k).eqNullSafe(F.try_element_at(cf, k))))


def changed_tokens(original: Column, cf: Column, cut=tokenised) -> Column:
    """``attribute__token`` for the lower-cased tokens that only one of the two values of an attribute has."""
    def of(k: Column) -> Column:
        a, b = (F.array_distinct(cut(F.lower(F.coalesce(F.try_element_at(m, k), F.lit(""))))) for m in (original, cf))
        return F.transform(F.array_union(F.array_except(a, b), F.array_except(b, a)), lambda t: F.concat(k, F.lit("__"), t))

    return F.array_sort(F.flatten(F.transform(F.map_keys(original), of)))


def cf_alignment(tokens: DataFrame, attributes: DataFrame, k: int = 3) -> DataFrame:
    """What the counterfactuals of a token and an attribute result share, a row for each id that has both: coverage, precision, f1,
    jaccard, ndcg (token attributes by the number of their changed tokens), sparsities, their ratio ger, and cf_similarity."""
    both = joined(tokens, attributes).where("a_cf is not null and b_cf is not null")
    both = both.withColumns({"_t": changed_tokens(F.col("a_original"), F.col("a_cf")), "_a": changed_attributes(F.col("a_original"), F.col("b_cf"))})
    both = both.withColumn("_ta", F.array_distinct(F.transform("_t", attribute_of)))
    order = F.transform("_ta", lambda x: F.struct((-F.size(F.filter(F.col("_t"), lambda t: attribute_of(t) == x))).alias("n"), x.alias("a")))
    both = both.withColumn("_top", F.slice(F.transform(F.array_sort(order), lambda x: x["a"]), 1, k))
    text = lambda c: F.concat_ws(" ", F.map_values(c))
    both = both.withColumns({"_m": metrics.alignment(F.col("_ta"), F.col("_a")), "attr_sparsity": F.size("_a") / F.size("b_cf"), "tok_sparsity": F.size("_t") / F.size(F.split(text("a_original"), " "))})
    return both.select(
        "id", F.col("_m.coverage").alias("coverage"), F.col("_m.precision").alias("prec"), F.col("_m.f1").alias("f1"), F.col("_m.jaccard").alias("jaccard"), metrics.ndcg(F.col("_top"), F.col("_a")).alias("ndcg"),
        "attr_sparsity", "tok_sparsity", (F.col("tok_sparsity") / (F.col("attr_sparsity") + 1e-10)).alias("ger"), change_cosine(text("a_original"), text("b_cf"), text("a_cf")).alias("cf_similarity"),
    )


def saliency_on_cf(results: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """id, k, overlap, mass: of the tokens that the counterfactual changes, the share among the k most salient; and the share of
    saliency on them.  Attribute results are held against the attributes of those tokens."""
    rows = results.where("cf is not null and saliency is not null").withColumn("_t", changed_tokens(F.col("original"), F.col("cf"), words))
    bare = ~F.exists(F.map_keys("saliency"), lambda x: x.contains("__"))
    rows = rows.withColumn("_c", F.when(bare, F.array_distinct(F.transform("_t", attribute_of))).otherwise(F.col("_t"))).withColumn("_r", ranked_keys(F.col("saliency")))
    total = F.aggregate(F.map_values("saliency"), F.lit(0.0), lambda s, v: s + v)
    on = F.aggregate(F.filter(F.map_entries("saliency"), lambda x: F.array_contains("_c", x["key"])), F.lit(0.0), lambda s, x: s + x["value"])
    rows = rows.withColumns({"mass": F.coalesce(F.try_divide(on, total), F.lit(0.0)), "k": F.explode(F.array(*[F.lit(k) for k in ks]))})
    return rows.select("id", "k", F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice("_r", F.lit(1), F.col("k")), F.col("_c"))), F.size("_c")), F.lit(0.0)).alias("overlap"), "mass")


def top_features(results: DataFrame, n_columns: int, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """explainer, id, threshold, features: what faithfulness masks.  The most salient come first; for explainers whose name does not
    begin with ``certa``, the least salient where the prediction is 0 (decided row by row)."""
    rank = ranked_keys(F.col("saliency"), ~F.col("explainer").startswith("certa") & (F.col("prediction") == 0))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(max(1, int(t * n_columns))).alias("k")) for t in thresholds])).alias("x")
    return results.where("saliency is not null").select("explainer", "id", rank.alias("r"), each).select("explainer", "id", "x.threshold", F.slice("r", F.lit(1), F.col("x.k")).alias("features"))


def without_features(rows: DataFrame, features: str, names: list[str]) -> DataFrame:
    """``rows`` without the listed features: attributes are blanked, of token features the token is taken out wherever it stands."""
    def left(name: str) -> Column:
        own = F.transform(F.filter(features, lambda f: f.startswith(f"{name}__")), lambda f: F.substring(f, F.lit(len(name) + 3), F.length(f)))
        return F.when(F.array_contains(features, name), F.lit("")).otherwise(F.aggregate(own, F.col(name), lambda v, t: F.replace(v, t, F.lit(""))))

    return rows.withColumns({n: left(n) for n in names})


def area_under(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, auc: trapezoids over the points of each group."""
    w = Window.partitionBy(by).orderBy(x)
    steps = points.select(by, ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a"))
    return steps.groupBy(by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))
