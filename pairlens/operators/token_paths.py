"""Token paths: the free record turns into the support record one token at a time, in a seeded order."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..written import written
from .matchers import Matcher, SqlMatcher
from .pairs import L, R, attributes

PATHS = 3


def paths_of(support: DataFrame, paths: int = PATHS) -> DataFrame:
    """A row for each support record with ``paths``, an array of (path, codes, features): the places where the two records differ, in
    the path's order, as numbers of attribute and position and as the features that they alter; a token that only one record has is
    dropped or added.  Beside it are the free record's tokens, ``_z_<attribute>`` (was, now), and the record that stays,
    ``p_<attribute>``.  All of it follows from the row itself."""
    names = attributes(support)
    left = F.col("side") == "L"
    free = lambda a: F.split(F.coalesce(F.when(left, F.col(L + a)).otherwise(F.col(R + a)), F.lit("")), " ")
    prefix = F.when(left, F.lit(L)).otherwise(F.lit(R))
    zipped = [F.zip_with(free(a), F.split(F.coalesce(F.col(f"c_{a}"), F.lit("")), " "), lambda f, s: F.struct(f.alias("was"), s.alias("now"))).alias(f"_z_{a}") for a in names]
    pivots = [F.when(left, F.col(R + a)).otherwise(F.col(L + a)).alias(f"p_{a}") for a in names]

    def places(a: str) -> Column:
        seeds = F.array(*[F.lit(p) for p in range(paths)])
        seed = lambda i: F.transform(seeds, lambda p: F.md5(F.concat_ws("|", p.cast("string"), F.lit(a), i.cast("string"))))
        at = lambda z, i: F.when(~z["was"].eqNullSafe(z["now"]), F.struct(seed(i).alias("seeds"), _code(names, a, i).alias("code"), F.concat("_prefix", F.lit(f"{a}__"), F.coalesce(z["was"], F.lit(""))).alias("feature")))
        return F.array_compact(F.transform(f"_z_{a}", at))

    rows = support.select("pair_id", "side", "decision", F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string")).alias("triangle_id"), prefix.alias("_prefix"), *zipped, *pivots)
    rows = rows.withColumn("_differ", F.flatten(F.array(*map(places, names))))
    rows = rows.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in range(paths)])))
    rows = rows.withColumn("_o", F.sort_array(F.transform("_differ", lambda x: F.struct(F.get(x["seeds"], F.col("_p")).alias("seed"), x["code"].alias("code"), x["feature"].alias("feature")))))
    return rows.select("pair_id", "side", "decision", "triangle_id", F.col("_p").alias("path"), F.col("_o.code").alias("codes"), F.col("_o.feature").alias("features"), *[f"_z_{a}" for a in names], *[f"p_{a}" for a in names])


def _code(names: list[str], attribute: str, position: Column) -> Column:
    return position.cast("long") * len(names) + names.index(attribute)


def steps(support: DataFrame, matcher: Matcher | None = None, features: DataFrame | None = None, early: bool = False) -> DataFrame:
    """pair_id, triangle_id, path, step, altered, flip: the pair after each step of each path, the sorted features that it has altered so
    far, and whether its decision turned.  What is dealt by pair_id stays so.

    With ``features``(pair_id, feature), steps that alter any other token are left out, unless that leaves a triangle none.  With
    ``early``, a pair has no steps after the first at which all of its triangles and paths have flipped; few of those are asked."""
    names, matcher = attributes(support), matcher or SqlMatcher()
    rows = paths_of(support).withColumn("last", F.size("codes"))
    if features is not None:
        allowed = features.groupBy("pair_id").agg(F.collect_set("feature").alias("_allowed"))  # the tokens of one pair
        rows = rows.join(allowed, "pair_id", "left").withColumn("_allowed", F.coalesce("_allowed", F.array().cast("array<string>")))
        other = F.array_position(F.transform("features", lambda y: F.array_contains(F.col("_allowed"), y)), F.lit(False))
        rows = rows.withColumn("_in", F.when(other > 0, (other - 1).cast("int")).otherwise(F.col("last"))).drop("_allowed")
        most = F.max("_in").over(Window.partitionBy("pair_id", "triangle_id"))
        rows = rows.withColumn("_most", most).withColumn("last", F.when(F.col("_most") > 0, F.col("_in")).otherwise(F.col("last"))).drop("_in", "_most")

    def shown(rows: DataFrame) -> DataFrame:
        """Each step of each path, up to the last, with the free record's values."""
        at = rows.withColumn("step", F.explode(F.filter(F.sequence(F.lit(1), F.greatest("last", F.lit(1))), lambda i: i <= F.col("last"))))
        at = at.withColumn("_c", F.slice("codes", F.lit(1), F.col("step")))
        token = lambda a: lambda z, i: F.when(F.array_contains(F.col("_c"), _code(names, a, i)), z["now"]).otherwise(z["was"])
        value = lambda a: F.array_join(F.transform(f"_z_{a}", token(a)), " ")
        return at.select("pair_id", "side", "decision", "triangle_id", "path", "step", F.sort_array(F.slice("features", F.lit(1), F.col("step"))).alias("altered"), *[value(a).alias(f"f_{a}") for a in names], *[f"p_{a}" for a in names])

    free, pivot, left = [F.col(f"f_{a}") for a in names], [F.col(f"p_{a}") for a in names], F.col("side") == "L"
    pair = [F.when(left, f).otherwise(p) for f, p in zip(free, pivot, strict=True)], [F.when(left, p).otherwise(f) for f, p in zip(free, pivot, strict=True)]

    def turned(rows: DataFrame) -> DataFrame:
        out = matcher.decide(rows, *pair, names, "_new").withColumn("flip", F.coalesce((F.col("_new") != F.col("decision")).cast("int"), F.lit(0)))
        return out.select("pair_id", "triangle_id", "path", "step", "altered", "flip")

    if not early:
        return turned(shown(rows))
    if not matcher.asks:  # to decide a step costs less than to keep it: the last steps first, then all up to them
        good = turned(shown(rows)).groupBy("pair_id", "step").agg(F.min("flip").alias("_all")).where("_all = 1").groupBy("pair_id").agg(F.min("step").alias("_last"))
        return turned(shown(rows.join(good, "pair_id", "left").withColumn("last", F.least("last", "_last"))))
    return _early(written(shown(rows)), turned)


def _early(rows: DataFrame, turned: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps in rounds of 1, 1, 2, 4, ...: pairs of which one step has flipped everywhere are left out of the rounds that follow, and of
    its round the steps behind it are left out too."""
    last = rows.agg(F.max("step")).first()[0] or 0
    open_, parts, start, end = rows.select("pair_id").distinct(), [rows.limit(0).select("pair_id", "triangle_id", "path", "step", "altered", F.lit(0).alias("flip"))], 1, 1
    while start <= last:
        now = written(turned(rows.where(F.col("step").between(start, end)).join(open_, "pair_id", "left_semi")))
        good = now.groupBy("pair_id", "step").agg(F.min("flip").alias("_all")).where("_all = 1").groupBy("pair_id").agg(F.min("step").alias("_last"))
        good = written(good)
        parts.append(now.join(good, "pair_id", "left").where("_last is null or step <= _last").drop("_last"))
        open_ = written(open_.join(good, "pair_id", "left_anti"))
        start, end = end + 1, 2 * end
    return functools.reduce(DataFrame.unionByName, parts)


def token_saliency(stepped: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """pair_id, feature, saliency: flips of the altered sets with the token over all flips; pairs without flips have none.  Tokens
    outside ``features``(pair_id, feature), where given, are left out."""
    # a null beside the altered tokens counts the flips; counts by pair are few, so only they are put in order
    hits = stepped.where("flip = 1").select("pair_id", F.explode(F.array_append("altered", F.lit(None).cast("string"))).alias("feature"))
    counts = hits.groupBy("pair_id", "feature").agg(F.count("*").alias("c"))
    counts = counts.withColumn("_all", F.max(F.when(F.col("feature").isNull(), F.col("c"))).over(Window.partitionBy("pair_id")))
    out = counts.where("feature is not null").select("pair_id", "feature", (F.col("c") / F.col("_all")).alias("saliency"))
    return out if features is None else out.join(features.select("pair_id", "feature").distinct(), ["pair_id", "feature"], "left_semi")


def token_sufficiency(stepped: DataFrame) -> DataFrame:
    """pair_id, altered, sufficiency: of the steps that altered just these tokens, the share that flipped."""
    return stepped.groupBy("pair_id", "altered").agg(F.avg("flip").alias("sufficiency"))
