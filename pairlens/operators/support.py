"""Support search: records that turn a pair's decision when they stand in for one of its sides.

Candidates come from the whole of each source, found by its inverted lists.  With a ``size`` they come from a pool instead, drawn by a
hash of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_cosine, diff_label, words
from ..written import written
from . import search
from .calls import key
from .matchers import Matcher, SqlMatcher, sides
from .pairs import L, R, attributes, record_text

#: Triangles of an explanation.
TRIANGLES, SEED = 10, "7"


def pool(source: DataFrame, size: int, seed: str = SEED) -> DataFrame:
    return source.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))).orderBy("_h", "id").limit(size).drop("_h")


def scored_whole(asked: DataFrame, source: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """asked(text, most) and source(c_id, c_text) to text, most, c_id, score: of all records of the source those with a score of
    ``least`` or more, or else the k of the highest scores (of the lowest, where ``most`` is false), ties going to the smaller id.

    Texts of equal word counts score alike, so each kind of them is searched once, under its least id: k records that come first are
    among the k first kinds, and of a kind the k least ids are enough."""
    asked = asked.distinct()
    if source.count() <= search.SMALL:
        return search.against_all(asked, source.select("c_id", words(F.col("c_text")).alias("w")), k, least)
    asked = written(asked.withColumn("bag", search.bag(F.col("text"))))
    own = source.withColumn("bag", search.bag(F.col("c_text")))
    if k is not None:
        own = own.withColumn("_p", F.row_number().over(Window.partitionBy("bag").orderBy("c_id"))).where(F.col("_p") <= k)
    own = written(own.select("bag", "c_id"))
    kinds = written(own.groupBy("bag").agg(F.min("c_id").alias("c_id")).withColumnRenamed("bag", "c_text"))
    texts = lambda which: asked.where(which).select(F.col("bag").alias("text")).distinct()
    if least is not None:
        found = search.alike(texts(F.lit(True)), kinds, least).join(asked.select("bag", "most").distinct().withColumnRenamed("bag", "text"), "text")
    else:
        high, low = search.most_alike(texts(F.col("most")), kinds, k), search.least_alike(texts(~F.col("most")), kinds, k)
        found = high.withColumn("most", F.lit(True)).unionByName(low.withColumn("most", F.lit(False)))
    every = found.join(kinds, "c_id").select(F.col("text").alias("asked"), "most", "score", F.col("c_text").alias("bag")).join(own, "bag")
    if k is not None:
        order = F.when(F.col("most"), -F.col("score")).otherwise(F.col("score"))
        every = written(every.withColumn("_p", F.row_number().over(Window.partitionBy("asked", "most").orderBy(order, "c_id"))).where(F.col("_p") <= k))
    return asked.join(every.select(F.col("asked").alias("bag"), "most", "c_id", "score"), ["bag", "most"]).select("text", "most", "c_id", "score")


def candidates(rows: DataFrame, left: DataFrame, right: DataFrame, n: int = TRIANGLES, size: int | None = None, matcher: Matcher | None = None) -> DataFrame:
    """For each pair and side, the 2n records of the source (or of a sample of ``size`` of it) most like the other side (least like, if
    the pair matches) with their decision; only those are put to the matcher.  Records have distinct ids.

    side L: the candidate stands in for the left record; its attributes are ``c_<attribute>``."""
    names, matcher = attributes(rows), matcher or SqlMatcher()
    asked = written(matcher.decide(rows, *sides(rows), "decision").where("decision is not null"))  # each pair is asked once
    kept = ["pair_id", "decision", *[p + a for p in (L, R) for a in ["id", *names]]]
    parts = []
    for side, source, other in (("L", left, R), ("R", right, L)):
        own = (source if size is None else pool(source, size)).select(F.col("id").alias("c_id"), *[F.col(a).alias(f"c_{a}") for a in names])
        texts = asked.withColumn("text", record_text(*[other + a for a in names])).withColumn("most", F.col("decision") == 0)
        best = scored_whole(texts.select("text", "most"), own.select("c_id", record_text(*[f"c_{a}" for a in names]).alias("c_text")), 2 * n)
        parts.append(texts.join(best, ["text", "most"]).join(own, "c_id").select(F.lit(side).alias("side"), *kept, "c_id", *[f"c_{a}" for a in names], "score"))
    order = F.when(F.col("decision") == 0, -F.col("score")).otherwise(F.col("score"))
    found = parts[0].unionByName(parts[1]).withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(order, "c_id")))
    on_left = F.col("side") == "L"
    changed = [F.when(on_left, F.col(f"c_{a}")).otherwise(F.col(L + a)) for a in names], [F.when(on_left, F.col(R + a)).otherwise(F.col(f"c_{a}")) for a in names]
    return matcher.decide(found, *changed, names, "c_decision")


def copies(rows: DataFrame) -> DataFrame:
    """Stand-ins made of the explained pair itself, for pairs with too few supports: for each side, the other side's record with one
    attribute cut to a proper prefix or suffix, under negative ids; (pair_id, side, c_id, c_<attribute>, attribute, position, diff),
    where diff is what the cut takes away."""
    names = attributes(rows)
    parts = []
    for side, other in (("L", R), ("R", L)):
        record = rows.select(F.col("pair_id").alias("id"), *[F.col(other + a).cast("string").alias(a) for a in names])
        cut = subsequences(record, names)
        whole = record.select("id", *[F.col(a).alias(f"_{a}") for a in names])
        at = lambda prefix: F.coalesce(*[F.when(F.col("attribute") == a, F.col(prefix + a)) for a in names])
        number = F.row_number().over(Window.partitionBy("id").orderBy("attribute", "n", "kind", at("")))
        parts.append(cut.join(whole, "id").select(F.col("id").alias("pair_id"), F.lit(side).alias("side"), (-number).cast("long").alias("c_id"), *[F.col(a).alias(f"c_{a}") for a in names], "attribute", F.array_position(F.array(*[F.lit(a) for a in names]), F.col("attribute")).cast("int").alias("position"), diff_label(at("_"), at("")).alias("diff")))
    return parts[0].unionByName(parts[1])


def augmented(found: DataFrame, rows: DataFrame, n: int = TRIANGLES, matcher: Matcher | None = None) -> DataFrame:
    """``found`` candidates with copies of the pair, for pairs of which fewer than n candidates turn the decision; as of records, the
    2n copies most like the other side (least like, if the pair matches) are put to the matcher."""
    matcher = matcher or SqlMatcher()
    turned = found.groupBy("pair_id").agg(F.max("decision").alias("decision"), F.sum((F.col("c_decision") != F.col("decision")).cast("int")).alias("_turned"))
    short = turned.where(F.coalesce("_turned", F.lit(0)) < n).select("pair_id", "decision")
    return found.unionByName(_cut(rows.join(short, "pair_id"), n, matcher).select(found.columns))


def _cut(short: DataFrame, n: int, matcher: Matcher) -> DataFrame:
    """The copies that ``augmented`` adds to decided pair rows with too few candidates."""
    names = attributes(short)
    made = copies(short).drop("attribute", "position", "diff").join(short, "pair_id")
    other = F.when(F.col("side") == "L", record_text(*[R + a for a in names])).otherwise(record_text(*[L + a for a in names]))
    made = made.withColumn("_a", words(other)).withColumn("_b", words(record_text(*[f"c_{a}" for a in names]))).withColumn("score", count_cosine(F.col("_a"), F.col("_b")))
    order = F.when(F.col("decision") == 0, -F.col("score")).otherwise(F.col("score"))
    made = made.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(order, F.desc("c_id")))).where(F.col("place") <= 2 * n)
    on_left = F.col("side") == "L"
    changed = [F.when(on_left, F.col(f"c_{a}")).otherwise(F.col(L + a)) for a in names], [F.when(on_left, F.col(R + a)).otherwise(F.col(f"c_{a}")) for a in names]
    return matcher.decide(made, *changed, names, "c_decision")


def balanced(found: DataFrame, n: int = TRIANGLES) -> DataFrame:
    """The support set: candidates of the opposite decision, as many of each side (or all of one, if the other has none), in hash
    order, and of more than n the first and last n / 2."""
    turned = found.where("c_decision != decision").drop("place")
    each = Window.partitionBy("pair_id", "side")
    turned = turned.withColumn("_n", F.count("*").over(each)).withColumn("rank", F.row_number().over(each.orderBy(F.md5(F.concat("side", F.lit("@"), F.col("c_id").cast("string"))), "c_id")))
    sides = Window.partitionBy("pair_id")
    least, most, kinds = F.min("_n").over(sides), F.max("_n").over(sides), F.size(F.collect_set("side").over(sides))
    turned = turned.withColumn("_k", F.when(kinds > 1, least).otherwise(most)).where("rank <= _k")
    turned = turned.withColumn("ord", F.row_number().over(sides.orderBy("side", "rank"))).withColumn("_t", F.count("*").over(sides))
    return turned.where(f"ord <= {n // 2} or ord > _t - {n // 2} or _t <= {n}").drop("_n", "_k", "_t", "rank")


def supports(rows: DataFrame, left: DataFrame, right: DataFrame, n: int = TRIANGLES, size: int | None = None, matcher: Matcher | None = None, copied: bool = True) -> DataFrame:
    """``balanced`` of the ``candidates``, with ``augmented`` between if ``copied``, without a row for each candidate of each pair.

    Which candidates turn a pair depends on its decision and on the record that stays, so they are listed once for each of these (at
    most 2n, in hash order), and a pair takes its supports from two lists.  Pairs whose lists are too short go the longer way."""
    names, matcher = attributes(rows), matcher or SqlMatcher()
    kept = ["pair_id", "decision", *[p + a for p in (L, R) for a in ["id", *names]]]
    asked = matcher.decide(rows, *sides(rows), "decision").where("decision is not null")
    asked = written(asked.select(*kept, *[key(*[F.col(p + a).cast("string") for a in names]).alias(f"_{p}") for p in (L, R)]))
    every, records = asked, []
    for side, source, other in (("L", left, R), ("R", right, L)):
        own = (source if size is None else pool(source, size)).select(F.col("id").alias("c_id"), *[F.col(a).alias(f"c_{a}") for a in names])
        stays = asked.groupBy(f"_{other}", "decision").agg(F.first(F.struct(*[other + a for a in names])).alias("r")).select(f"_{other}", "decision", "r.*")
        stays = written(stays.withColumn("text", record_text(*[other + a for a in names])).withColumn("most", F.col("decision") == 0))
        best = scored_whole(stays.select("text", "most"), own.select("c_id", record_text(*[f"c_{a}" for a in names]).alias("c_text")), 2 * n)
        met = stays.join(best, ["text", "most"]).join(own, "c_id")
        both = [F.col(f"c_{a}") for a in names], [F.col(other + a) for a in names]
        met = matcher.decide(met, *(both if side == "L" else both[::-1]), names, "c_decision").where("c_decision != decision")
        entry = F.struct(F.md5(F.concat(F.lit(f"{side}@"), F.col("c_id").cast("string"))).alias("h"), "c_id", "score")
        listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(F.lit(side).alias("side"), x["c_id"].alias("c_id"), x["score"].alias("score")))
        every = every.join(met.groupBy(f"_{other}", "decision").agg(listed.alias(f"_of_{side}")), [f"_{other}", "decision"], "left")
        every = every.withColumn(f"_n_{side}", F.coalesce(F.size(f"_of_{side}"), F.lit(0)))
        records.append(own.withColumn("side", F.lit(side)))
    lists = [F.when(F.col(f"_n_{s}") > 0, F.col(f"_of_{s}")).otherwise(F.array()) for s in "LR"]
    own = records[0].unionByName(records[1])

    def shown(df: DataFrame, *more: str) -> DataFrame:
        out = df.select(*kept, F.inline("_taken")).join(own, ["side", "c_id"])
        return out.select("side", *kept, "c_id", *[f"c_{a}" for a in names], "score", (1 - F.col("decision")).alias("c_decision"), *more)

    if copied:
        every = written(every)
    l, r = F.col("_n_L"), F.col("_n_R")  # noqa: E741
    k = F.when((l > 0) & (r > 0), F.least(l, r)).otherwise(F.greatest(l, r))
    taken = F.concat(*[F.slice(x, F.lit(1), k) for x in lists])
    numbered = F.transform(taken, lambda x, i: F.struct(x["side"].alias("side"), x["c_id"].alias("c_id"), x["score"].alias("score"), (i + 1).cast("int").alias("ord")))
    enough = (every.where(l + r >= n) if copied else every).withColumn("_taken", numbered).withColumn("_t", F.size("_taken"))
    enough = enough.withColumn("_taken", F.filter("_taken", lambda x: (x["ord"] <= n // 2) | (x["ord"] > F.col("_t") - n // 2) | (F.col("_t") <= n)))
    out = shown(enough, "ord")
    if not copied:
        return out
    short = every.where(l + r < n)
    found = shown(short.withColumn("_taken", F.concat(*lists)))
    made = _cut(short.select(kept), n, matcher).select(found.columns)
    return out.unionByName(balanced(found.unionByName(made), n))


def triangle_id() -> F.Column:
    return F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string"))


def triangles(support: DataFrame) -> DataFrame:
    """pair_id, triangle_id, side, free_id, pivot_id, support_id: the free record is that of the support's side."""
    left = F.col("side") == "L"
    return support.select("pair_id", F.concat_ws("|", "pair_id", "side", F.col("c_id").cast("string")).alias("triangle_id"), "side", F.when(left, F.col(f"{L}id")).otherwise(F.col(f"{R}id")).alias("free_id"), F.when(left, F.col(f"{R}id")).otherwise(F.col(f"{L}id")).alias("pivot_id"), F.col("c_id").alias("support_id"))


def mixed_triangles(pairs: DataFrame) -> DataFrame:
    """Positive and negative pairs that share a record: (l, r, l') on a shared right id, (r, l, r') on a shared left id."""
    p, n = pairs.where("label = 1"), pairs.where("label = 0")
    a = p.select(f"{L}id", f"{R}id").join(n.select(F.col(f"{L}id").alias("s"), f"{R}id"), f"{R}id").select(F.lit("L").alias("side"), F.col(f"{L}id").alias("free_id"), F.col(f"{R}id").alias("pivot_id"), F.col("s").alias("support_id"))
    b = p.select(f"{L}id", f"{R}id").join(n.select(f"{L}id", F.col(f"{R}id").alias("s")), f"{L}id").select(F.lit("R").alias("side"), F.col(f"{R}id").alias("free_id"), F.col(f"{L}id").alias("pivot_id"), F.col("s").alias("support_id"))
    return a.unionAll(b)


def subsequences(source: DataFrame, names: list[str]) -> DataFrame:
    """Each record with one attribute cut to a proper prefix or suffix: 2 (words - 1) copies of each attribute."""
    pieces = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.split(F.col(a), " ").alias("w")) for a in names])).alias("x")
    cut = source.select("id", *names, pieces).select("id", *names, "x.attribute", "x.w").where(F.size("w") > 1)
    cut = cut.select("id", *names, "attribute", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("n"))
    both = cut.withColumn("kind", F.explode(F.array(F.lit("prefix"), F.lit("suffix"))))
    value = F.array_join(F.when(F.col("kind") == "prefix", F.slice("w", F.lit(1), F.col("n"))).otherwise(F.slice("w", F.size("w") - F.col("n") + 1, F.col("n"))), " ")
    return both.withColumn("_v", value).select("id", "attribute", "kind", "n", *[F.when(F.col("attribute") == a, F.col("_v")).otherwise(F.col(a)).alias(a) for a in names])
