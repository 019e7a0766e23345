"""Pair rows: two records side by side, their attributes told apart by prefix."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..written import written
from .calls import key

L, R = "ltable_", "rtable_"


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def attributes(df: DataFrame) -> list[str]:
    """Attributes that both sides of pair rows have, in order."""
    return [c[len(L) :] for c in df.columns if c.startswith(L) and c != f"{L}id" and R + c[len(L) :] in df.columns]


def pair_id(l: Column | None = None, r: Column | None = None) -> Column:  # noqa: E741
    return F.concat(F.lit("0@"), F.col(f"{L}id") if l is None else l, F.lit("#1@"), F.col(f"{R}id") if r is None else r)


def one_each(source: DataFrame) -> DataFrame:
    """The least record of each id."""
    rest = [c for c in source.columns if c != "id"]
    return source.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col("id") if c == "id" else F.col(f"r.{c}") for c in source.columns]) if rest else source.distinct()


def merge(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair rows of a labelled pair list; pairs with an unknown id go, and of records that share an id the least is taken, by its
    values in order."""
    out = pairs.join(prefixed(one_each(left), L), f"{L}id").join(prefixed(one_each(right), R), f"{R}id")
    return out.select(pair_id().alias("pair_id"), "label", *[c for c in out.columns if c.startswith((L, R))])


def distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of each set of pair rows with equal values, that of the least pair_id, and the members of the sets: pair_id, like (the
    pair_id of that one) and the ids of the pair's records."""
    ids = [f"{L}id", f"{R}id"]
    keyed = written(rows.withColumn("_key", key(*[F.col(p + a).cast("string") for p in (L, R) for a in attributes(rows)])))
    kinds = written(keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), "pair_id").alias("r")))
    members = keyed.select("pair_id", *ids, "_key").join(kinds.select("_key", F.col("r.pair_id").alias("like")), "_key")
    return kinds.select("r.*"), written(members.select("pair_id", "like", *ids).distinct())


def told(of_distinct: DataFrame, members: DataFrame) -> DataFrame:
    """A table of distinct pairs, by pair_id, as one of all pairs: each pair has the rows of the one like it, under its own ids."""
    named = [c for c in of_distinct.columns if c in members.columns and c != "pair_id"]
    out = of_distinct.drop(*named).withColumnRenamed("pair_id", "like").join(members.select("pair_id", "like", *named), "like")
    if "triangle_id" in of_distinct.columns:  # begins with the pair's id
        out = out.withColumn("triangle_id", F.concat("pair_id", F.substring("triangle_id", F.length("like") + 1, F.length("triangle_id"))))
    return out.select(of_distinct.columns)


def robust(rows: DataFrame) -> DataFrame:
    """Pair rows with their mirror images, and each side against itself (label 1); the reference does this for its last pair only."""
    names = attributes(rows)
    shown = lambda a, b: [F.col(f"{a}{c}").alias(f"{L}{c}") for c in ["id", *names]] + [F.col(f"{b}{c}").alias(f"{R}{c}") for c in ["id", *names]]
    kinds = [("pair", F.col("label"), L, R), ("mirror", F.col("label"), R, L), ("left", F.lit(1), L, L), ("right", F.lit(1), R, R)]
    parts = [rows.select(F.lit(k).alias("kind"), label.alias("label"), *shown(a, b)) for k, label, a, b in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def tuple_of(prefix: str, names: list[str]) -> Column:
    """A side as a map of texts; null becomes ``nan``, as matchers expect."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(prefix + n).cast("string"), F.lit("nan")) for n in names]))


def record_text(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def token_features(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, feature (``<prefixed attribute>__<token>``), attribute, position: each token of each attribute."""
    names = [p + a for p in (L, R) for a in attributes(rows)]
    pieces = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.split(F.col(n), " ").alias("t")) for n in names])).alias("x")
    out = rows.select(key, pieces).select(key, "x.attribute", F.posexplode("x.t").alias("position", "token"))
    return out.select(key, F.concat("attribute", F.lit("__"), "token").alias("feature"), "attribute", "position")


def feature_attribute(feature: Column) -> Column:
    return F.substring_index(feature, "__", 1)


#: A look-up goes through 2 ** attributes subsets: above so many, name the attributes to compare.
MAX_ATTRIBUTES = 12


def _parts(df: DataFrame, names: list[str], size: int) -> Column:
    """Each subset of so many attributes, none of them null, as a text of its number and values."""
    masks = [m for m in range(1, 1 << len(names)) if m.bit_count() == size]
    value = lambda n: F.concat(F.length(F.col(n).cast("string")).cast("string"), F.lit(":"), F.col(n).cast("string"))
    chosen = [[n for i, n in enumerate(names) if m >> i & 1] for m in masks]
    return F.explode(F.array_compact(F.array(*[F.concat(F.lit(f"{m}|"), *map(value, own)) for m, own in zip(masks, chosen, strict=True)])))  # null if any is null


def lookup(queries: DataFrame, records: DataFrame, names: list[str], key: str = "query_id") -> DataFrame:
    """The record that equals each query in the most attributes, if any; ties go to the smaller id.  Nulls equal nothing.

    Sizes of attribute sets are gone through from the largest on: records give the least id of each set's values, so a query meets one
    row for each of its sets, and those that found one are done."""
    if len(names) > MAX_ATTRIBUTES:
        raise ValueError(f"{len(names)} attributes make {2 ** len(names)} subsets: choose at most {MAX_ATTRIBUTES}")
    open_, parts = written(queries.select(key, *names)), []
    kinds = written(records.groupBy(*names).agg(F.min("id").alias("id")))  # of equal records the least is enough
    for size in range(len(names), 0, -1):
        least = kinds.select("id", _parts(kinds, names, size).alias("_part")).groupBy("_part").agg(F.min("id").alias("id"))
        found = open_.select(key, _parts(open_, names, size).alias("_part")).join(least, "_part").groupBy(key).agg(F.min("id").alias("id"))
        parts.append(written(found.withColumn("same", F.lit(size).cast("long"))))
        open_ = written(open_.join(parts[-1], key, "left_anti"))
        if open_.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, parts)
