"""Does a saliency hold?  The most salient features are changed towards the other decision, and the matcher is asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matchers import Matcher, sides
from .pairs import L, R, attributes


def _other(name: str) -> str:
    return R + name[len(L) :] if name.startswith(L) else L + name[len(R) :]


def change_attributes(rows: DataFrame, features: str, label: str) -> DataFrame:
    """Pair rows with the listed attributes blanked (label 1) or taken from the other side (label 0), one after the other."""
    names = [p + a for p in (L, R) for a in attributes(rows)]
    both = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    twin = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(_other(n)) for n in names]))
    put = lambda m, f, v: F.transform_values(m, lambda k, old: F.when(k == f, v).otherwise(old))
    new = F.aggregate(features, both, lambda m, f: put(m, f, F.when(F.col(label) == 1, F.lit("")).otherwise(F.try_element_at(m, F.try_element_at(F.col("_twin"), f)))))
    return rows.withColumn("_twin", twin).withColumn("_m", new).withColumns({n: F.element_at("_m", F.lit(n)) for n in names}).drop("_m", "_twin")


def quoted(text: Column) -> Column:
    """A pattern that finds a text as it is, in any case."""
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def change_tokens(rows: DataFrame, features: str, label: str) -> DataFrame:
    """Pair rows with the listed tokens (``attribute__token``) taken out of their attribute (label 1), or replaced by what the other
    side has: the token itself, if it stands there, else that side's whole value (label 0); one after the other, in any case."""
    names = [p + a for p in (L, R) for a in attributes(rows)]
    state = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("nan")) for n in names]))
    twin = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(_other(n)) for n in names]))
    literal = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))  # noqa: E731  as a replacement

    def step(m: Column, f: Column) -> Column:
        attribute, token = F.substring_index(f, "__", 1), F.substring(f, F.length(F.substring_index(f, "__", 1)) + 3, F.length(f))
        value, other = F.try_element_at(m, attribute), F.try_element_at(m, F.try_element_at(F.col("_twin"), attribute))
        gone = F.trim(F.regexp_replace(F.regexp_replace(value, quoted(token), F.lit("")), F.lit(r"\s+"), F.lit(" ")))
        into = F.when(F.regexp_like(other, quoted(token)), token).otherwise(other)
        new = F.when(F.col(label) == 1, gone).otherwise(F.regexp_replace(value, quoted(token), literal(into)))
        return F.when((token == "") | attribute.isNull(), m).otherwise(F.transform_values(m, lambda k, old: F.when(k == attribute, new).otherwise(old)))

    return rows.withColumn("_twin", twin).withColumn("_m", F.aggregate(features, state, step)).withColumns({n: F.element_at("_m", F.lit(n)) for n in names}).drop("_m", "_twin")


def consistency(rows: DataFrame, ranked: DataFrame, matcher: Matcher, k_range: int = 6, tokens: bool = False) -> DataFrame:
    """explainer, pair_id, k, decision, new: what the matcher says when the first k = 0 .. k_range - 1 features are changed.  ``rows``
    have a ``decision``, ``ranked`` is (explainer, pair_id, names)."""
    each = rows.join(ranked, "pair_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_range - 1)))).withColumn("_f", F.slice("names", F.lit(1), F.col("k")))
    changed = (change_tokens if tokens else change_attributes)(each, "_f", "decision")
    return matcher.decide(changed, *sides(changed), "new").select("explainer", "pair_id", "k", "decision", "new")


def by_explainer(seen: DataFrame, k_range: int = 6) -> DataFrame:
    """explainer, consistency: the sum of the new decisions over the number of ks, as a mean over pairs."""
    per = seen.groupBy("explainer", "pair_id").agg((F.sum("new") / k_range).alias("c"))
    return per.groupBy("explainer").agg(F.avg("c").alias("consistency"))
