"""Metrics of explanations, on long tables of features or on ranked arrays of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(saliency: DataFrame, key: str = "pair_id", score: str = "saliency") -> DataFrame:
    """key, names: features in descending order of score, then name."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "feature")))
    return saliency.groupBy(key).agg(F.transform(items, lambda x: x["feature"]).alias("names"))


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Rank-biased overlap of two arrays of names (columns, not expressions)."""
    k = F.greatest(F.size(a), F.size(b))
    shared = lambda d: F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)))
    terms = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d) * shared(d) / d)
    return F.when(k == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / k * F.pow(F.lit(p), k) + (1 - p) / p * terms)


def kendall(a: Column, b: Column) -> Column:
    """Tau-b of the names' lexical order at equal ranks; names of a list differ, so there are no ties.  0 for under two ranks."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, F.lit(2))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    at = lambda x, i: F.get(x, i - 1)
    sign = lambda x, z: F.when(at(x, z["i"]) < at(x, z["j"]), 1).when(at(x, z["i"]) > at(x, z["j"]), -1).otherwise(0)
    total = F.aggregate(pairs, F.lit(0), lambda s, z: s + sign(a, z) * sign(b, z))
    return F.when(n < 2, F.lit(0.0)).otherwise(2.0 * total / (n * (n - 1)))


def ndcg(names: Column, relevant: Column) -> Column:
    """nDCG of a ranked array against an array of relevant names; 0 if none is relevant."""
    gain = lambda i: 1 / F.log2(i.cast("double") + 2)
    dcg = F.aggregate(F.transform(names, lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    hits = F.size(F.filter(names, lambda x: F.array_contains(relevant, x)))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(hits - 1, F.lit(0))), gain), F.lit(0.0), lambda s, x: s + x)
    return F.when(hits == 0, F.lit(0.0)).otherwise(dcg / ideal)


def concordance_correlation(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row, ``ccc``: 2 cov / (var + var + (mean - mean) ** 2) with population moments; null without variance or rows."""
    rows = df.select(F.col(truth).cast("double").alias("t"), F.col(predicted).cast("double").alias("p")).dropna()
    s = rows.agg(F.covar_pop("t", "p").alias("c"), F.var_pop("t").alias("vt"), F.var_pop("p").alias("vp"), F.avg("t").alias("mt"), F.avg("p").alias("mp"))
    return s.select(F.try_divide(2 * F.col("c"), F.col("vt") + F.col("vp") + F.pow(F.col("mt") - F.col("mp"), F.lit(2))).alias("ccc"))


def auc(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row, ``auc``: trapezoids over all points; thresholds are few, so one task orders them."""
    w = Window.orderBy(x)
    rows = points.select(((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a"))
    return rows.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def masked(rows: DataFrame, top: DataFrame, names: list[str]) -> DataFrame:
    """Pair rows with the attributes in ``features`` of ``top``(pair_id, features) blanked."""
    joined = rows.join(top, "pair_id", "left")
    return joined.withColumns({n: F.when(F.array_contains(F.coalesce("features", F.array().cast("array<string>")), n), F.lit("")).otherwise(F.col(n)) for n in names}).drop("features")


def cf_distance(original: Column, cf: Column) -> tuple[Column, Column]:
    """(proximity, sparsity) of a counterfactual map against the original's: 1 - the share of equal entries, and 1 - proximity over
    half the number of entries."""
    same = F.size(F.filter(F.map_keys(cf), lambda k: F.element_at(cf, k).eqNullSafe(F.element_at(original, k))))
    proximity = 1 - same / F.size(original)
    return proximity, 1 - proximity / (F.size(cf) / 2.0)


def diversity(cfs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, diversity: the mean share of entries in which two counterfactuals of a key differ.  Counted by value, not by pair."""
    n = cfs.groupBy(key).agg(F.count("*").alias("n"))
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("x")
    same = cfs.select(key, parts).groupBy(key, "x.f", "x.v").agg(F.count("*").alias("c")).groupBy(key).agg(F.sum(F.col("c") * F.col("c")).alias("same"))
    return n.join(same, key).select(key, (1 - F.col("same") / (F.lit(len(fields)) * F.col("n") * F.col("n"))).alias("diversity"))


def alignment(found: Column, truth: Column) -> Column:
    """struct<coverage, precision, f1, jaccard> of two sets."""
    both = F.size(F.array_intersect(found, truth))
    share = lambda d: F.coalesce(F.try_divide(both, d), F.lit(0.0))
    return F.struct(share(F.size(truth)).alias("coverage"), share(F.size(found)).alias("precision"), F.coalesce(F.try_divide(2.0 * both, F.size(found) + F.size(truth)), F.lit(0.0)).alias("f1"), share(F.size(F.array_union(found, truth))).alias("jaccard"))


def mass_overlap(tokens: DataFrame, attrs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, mass: sum over attributes of the lesser share of saliency, token saliency being summed by attribute."""
    share = lambda df, name: df.withColumn("_t", F.sum("s").over(Window.partitionBy(key))).select(key, "feature", F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(0.0).alias(name))
    by_token = tokens.groupBy(key, F.substring_index("feature", "__", 1).alias("feature")).agg(F.sum("saliency").alias("s"))
    both = share(by_token, "x").join(share(attrs.select(key, "feature", F.col("saliency").alias("s")), "y"), [key, "feature"])
    return both.groupBy(key).agg(F.sum(F.least("x", "y")).alias("mass"))
