"""Attribute lattices: subsets as bit masks, perturbed pairs, flips, and what follows from them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matchers import Matcher, SqlMatcher, sides
from .pairs import L, R, attributes

#: A lattice has 2 ** attributes nodes: above so many, name the attributes to vary.
MAX_ATTRIBUTES = 12


def subsets(names: list[str], sizes: range | None = None) -> list[int]:
    """Masks of the proper, non-empty subsets (or of those of the given sizes); bit i is names[i]."""
    if len(names) > MAX_ATTRIBUTES:
        raise ValueError(f"{len(names)} attributes make {2 ** len(names)} subsets: choose at most {MAX_ATTRIBUTES}")
    wanted = sizes or range(1, len(names))
    return [m for m in range(1, 1 << len(names)) if m.bit_count() in wanted]


def subset_name(side: Column, mask: Column, names: list[str]) -> Column:
    """``ltable_a/ltable_b``: the features of a subset, in attribute order."""
    prefix = F.when(side == "L", F.lit(L)).otherwise(F.lit(R))
    return F.concat_ws("/", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.concat(prefix, F.lit(n))) for i, n in enumerate(names)])


def perturbed(support: DataFrame, names: list[str] | None = None, sizes: range | None = None) -> DataFrame:
    """Each support row times each subset: the free side's attributes in the subset copied from the support record.

    ``names`` limits the attributes that vary, before anything is expanded."""
    names = names or attributes(support)
    return at_masks(support.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in subsets(names, sizes)]))), names)


def at_masks(rows: DataFrame, names: list[str]) -> DataFrame:
    """``perturbed`` of support rows that have a ``mask`` already."""
    every = attributes(rows)
    on = lambda a: F.col("mask").bitwiseAND(F.lit(1 << names.index(a))) != 0 if a in names else F.lit(False)
    left = F.col("side") == "L"
    shown = [F.when(left & on(a), F.col(f"c_{a}")).otherwise(F.col(L + a)).alias(L + a) for a in every] + [F.when(~left & on(a), F.col(f"c_{a}")).otherwise(F.col(R + a)).alias(R + a) for a in every]
    free = lambda a: F.when(left, F.col(L + a)).otherwise(F.col(R + a))
    listed = lambda value: F.concat_ws("|", *[F.when(on(a), F.coalesce(value(a), F.lit(""))) for a in names])
    return rows.select("pair_id", F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string")).alias("triangle_id"), "side", "decision", "mask", *shown, listed(free).alias("dropped"), listed(lambda a: F.col(f"c_{a}")).alias("copied"))


def flips(pert: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """Perturbed pairs with ``flip``: 1 if the decision turned."""
    decided = (matcher or SqlMatcher()).decide(pert, *sides(pert), "_new")
    return decided.withColumn("flip", F.coalesce((F.col("_new") != F.col("decision")).cast("int"), F.lit(0))).drop("_new")


def monotone_flips(support: DataFrame, names: list[str] | None = None, matcher: Matcher | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``flips``, level by level: of a triangle whose subsets of one level all flip, those of the next levels count as flipped without
    being put to the matcher (``asked`` is 0).  ``keep`` writes or persists a level, which the next one reads."""
    chosen = names or attributes(support)
    parts, done = [], None
    for level in range(1, len(chosen)):
        rows = perturbed(support, chosen, range(level, level + 1))
        if done is not None:
            over = rows.join(done, "triangle_id", "left_semi").withColumns({"flip": F.lit(1), "asked": F.lit(0)})
            rows = rows.join(done, "triangle_id", "left_anti")
            parts.append(over)
        now = flips(rows, matcher).withColumn("asked", F.lit(1))
        now = keep(now) if keep else now
        parts.append(now)
        all_good = now.groupBy("triangle_id").agg(F.min("flip").alias("f")).where("f = 1").select("triangle_id")
        done = all_good if done is None else done.union(all_good)
    return functools.reduce(DataFrame.unionByName, parts)


def ranking(flipped: DataFrame) -> DataFrame:
    """pair_id, side, mask, flips, tried."""
    return flipped.groupBy("pair_id", "side", "mask").agg(F.sum("flip").alias("flips"), F.count("*").alias("tried"))


def sufficiency(ranks: DataFrame, tri: DataFrame) -> DataFrame:
    """Flips of a subset over all triangles of its pair, of either side."""
    n = tri.groupBy("pair_id").agg(F.count("*").alias("triangles"))
    return ranks.join(n, "pair_id").withColumn("sufficiency", F.col("flips") / F.col("triangles"))


def saliency(ranks: DataFrame, names: list[str]) -> DataFrame:
    """pair_id, feature, saliency (necessity): flips of the subsets with the feature over all flips; 0 without flips."""
    both = [(s, p, i, n) for s, p in (("L", L), ("R", R)) for i, n in enumerate(names)]
    total = F.sum("flips")
    sums = ranks.groupBy("pair_id").agg(total.alias("_all"), *[F.sum(F.when((F.col("side") == s) & (F.col("mask").bitwiseAND(F.lit(1 << i)) != 0), F.col("flips")).otherwise(0)).alias(p + n) for s, p, i, n in both])
    rows = F.explode(F.array(*[F.struct(F.lit(p + n).alias("feature"), F.col(p + n).alias("f")) for _, p, _, n in both])).alias("x")
    return sums.select("pair_id", "_all", rows).select("pair_id", F.col("x.feature").alias("feature"), F.when(F.col("_all") > 0, F.col("x.f") / F.col("_all")).otherwise(0.0).alias("saliency"))


def summary(suff: DataFrame) -> DataFrame:
    """Subsets of the greatest sufficiency (above 0) of each pair that contain no smaller such subset of their side."""
    best = suff.withColumn("_m", F.max("sufficiency").over(Window.partitionBy("pair_id"))).where("sufficiency = _m and sufficiency > 0").drop("_m")
    # the subsets of one pair are at most 2 ** (attributes + 1), so they fit an array
    own = F.collect_list("mask").over(Window.partitionBy("pair_id", "side"))
    return best.withColumn("_o", own).where(~F.exists("_o", lambda o: (o != F.col("mask")) & (o.bitwiseAND(F.col("mask")) == o))).drop("_o")


def counterfactuals(hits: DataFrame) -> DataFrame:
    """The flipped perturbations of the summary's subsets, equal ones once, fewest attributes first."""
    names = attributes(hits)
    order = Window.partitionBy("pair_id").orderBy(F.bit_count("mask"), "side", "mask", "copied", "dropped")
    one = hits.groupBy("pair_id", "side", "mask", "dropped", "copied").agg(F.min("triangle_id").alias("triangle_id"), F.any_value("decision").alias("decision"), *[F.min(p + a).alias(p + a) for p in (L, R) for a in names])
    return one.withColumn("attr_count", F.bit_count("mask")).withColumn("place", F.row_number().over(order))


def monotone_levels(flipped: DataFrame) -> DataFrame:
    """triangle_id, level: the least level at which every subset of the triangle flips; deeper levels need no prediction."""
    levels = flipped.groupBy("triangle_id", F.bit_count("mask").alias("level")).agg(F.min("flip").alias("all_flip"))
    return levels.groupBy("triangle_id").agg(F.min(F.when(F.col("all_flip") == 1, F.col("level"))).alias("level"))


def algebra(found: DataFrame) -> DataFrame:
    """The lattice that the found subsets of each pair and side span: ``found`` (pair_id, side, mask) and all their joins (unions) and
    meets (intersections): pair_id, side, mask, origin, minimal, maximal, members.

    ``origin`` is found, join (a union of found ones) or meet (an intersection of those; subsets being a distributive lattice, no
    further round adds any).  ``minimal`` and ``maximal`` say of found ones whether no other found one lies below or above.
    ``members`` lists all masks of the lattice.  A lattice has at most 2 ** MAX_ATTRIBUTES masks, so a pair's fit an array; repeated
    rows count once, null masks are left out, and an intersection may be empty (mask 0)."""
    grow = lambda masks, both: F.aggregate(masks, F.array().cast("array<int>"), lambda got, m: F.array_distinct(F.concat(got, F.array(m), F.transform(got, lambda x: both(x, m)))))
    sets = found.groupBy("pair_id", "side").agg(F.array_sort(F.collect_set(F.col("mask").cast("int"))).alias("_found"))
    sets = sets.withColumn("_joins", grow(F.col("_found"), lambda x, m: x.bitwiseOR(m))).withColumn("members", F.array_sort(grow(F.col("_joins"), lambda x, m: x.bitwiseAND(m))))
    rows = sets.withColumn("mask", F.explode("members"))
    inside = lambda x, y: (x != y) & (x.bitwiseAND(y) == x)
    mask, own = F.col("mask"), F.array_contains("_found", F.col("mask"))
    origin = F.when(own, "found").when(F.array_contains("_joins", mask), "join").otherwise("meet")
    minimal, maximal = own & ~F.exists("_found", lambda x: inside(x, mask)), own & ~F.exists("_found", lambda x: inside(mask, x))
    return rows.select("pair_id", "side", "mask", origin.alias("origin"), minimal.cast("int").alias("minimal"), maximal.cast("int").alias("maximal"), "members")


def covers(closed: DataFrame, n: int) -> DataFrame:
    """The edges (pair_id, side, below, above) of the Hasse diagrams of ``algebra``'s lattices over ``n`` attributes.

    What covers a mask is the least of the members that contain it and one attribute more; of these, for all attributes, the minimal."""
    least = lambda want: F.aggregate(F.filter("members", lambda y: y.bitwiseAND(want) == want), F.lit(None).cast("int"), lambda got, y: F.coalesce(got.bitwiseAND(y), y))
    mask = F.col("mask")
    nearest = F.array_compact(F.array_distinct(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) == 0, least(mask.bitwiseOR(F.lit(1 << i)))) for i in range(n)])))
    rows = closed.withColumn("_near", F.explode(F.array(nearest)))  # computed once for each mask
    above = F.filter("_near", lambda y: ~F.exists("_near", lambda x: (x != y) & (x.bitwiseAND(y) == x)))
    return rows.select("pair_id", "side", mask.alias("below"), F.explode(above).alias("above"))


def hasse_dot(names: list[str]) -> str:
    """The cover relation of a lattice as a DOT graph; subsets are named as in ``subset_name``."""
    label = lambda m: "/".join(n for i, n in enumerate(names) if m >> i & 1) or "none"
    every = range(1 << len(names))
    return "digraph lattice {\n" + "".join(f'  "{label(m)}" -> "{label(m | 1 << i)}";\n' for m in every for i in range(len(names)) if not m >> i & 1) + "}\n"


def triangle_lattices(flipped: DataFrame, support: DataFrame) -> DataFrame:
    """What a triangle's lattice shows, a row for each node: its records (pivot, free, support) as level -1 and its subsets by rank
    (number of attributes), name order within: (triangle_id, level, node, flip)."""
    names = attributes(support)
    tid = F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string"))
    left = F.col("side") == "L"
    record = lambda kind, cols: F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", *cols).alias("node"))
    pivot, free = [F.when(left, F.col(R + a)).otherwise(F.col(L + a)) for a in names], [F.when(left, F.col(L + a)).otherwise(F.col(R + a)) for a in names]
    tops = support.select(tid.alias("triangle_id"), F.explode(F.array(record("pivot", pivot), record("free", free), record("support", [F.col(f"c_{a}") for a in names]))).alias("x"))
    tops = tops.select("triangle_id", F.lit(-1).alias("level"), F.concat_ws(": ", "x.kind", "x.node").alias("node"), F.lit(None).cast("int").alias("flip"))
    return tops.unionByName(flipped.select("triangle_id", F.bit_count("mask").alias("level"), subset_name(F.col("side"), F.col("mask"), names).alias("node"), "flip"))


def triangle_properties(support: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """triangle_id, identity, symmetry, transitivity: whether the matcher keeps them on the triangle's three records."""
    names, matcher = attributes(support), matcher or SqlMatcher()
    rec = {"f": [F.when(F.col("side") == "L", F.col(L + a)).otherwise(F.col(R + a)) for a in names], "p": [F.when(F.col("side") == "L", F.col(R + a)).otherwise(F.col(L + a)) for a in names], "s": [F.col(f"c_{a}") for a in names]}
    for x in rec:
        for y in rec:
            support = matcher.decide(support, rec[x], rec[y], names, f"_{x}{y}")
    m = lambda x, y: F.col(f"_{x}{y}")
    three = m("f", "p") + m("p", "s") + m("f", "s")
    return support.select(
        F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string")).alias("triangle_id"),
        (m("f", "f") + m("p", "p") + m("s", "s") == 3).cast("int").alias("identity"),
        ((m("f", "p") == m("p", "f")) & (m("p", "s") == m("s", "p")) & (m("f", "s") == m("s", "f"))).cast("int").alias("symmetry"),
        three.isin(0, 1, 3).cast("int").alias("transitivity"),
    )
