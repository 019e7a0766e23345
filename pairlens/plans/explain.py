"""Post-hoc explanation of all pairs in one plan, by any matcher."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lattice, support, token_paths
from ..operators import pairs as pair_rows
from ..operators.matchers import Matcher, SqlMatcher
from ..operators.pairs import L, R, attributes, merge, token_features
from ..written import written


@dataclass
class Explanation:
    """Tables of all pairs, computed when asked for.  Supports and rankings, which the others share, are written once to the shared
    folder, and so are flips and token steps where they cost a matcher's answers; those of a rule are made again by whoever needs them."""

    rows: DataFrame
    found: DataFrame
    names: list[str]
    vary: list[str] | None = None
    matcher: Matcher = field(default_factory=SqlMatcher)
    features: DataFrame | None = None
    strategy: str = "all"

    @property
    def distinct(self) -> Explanation:
        """The explanation that holds each set of equal pairs once."""
        return self

    def told(self, of_distinct: DataFrame) -> DataFrame:
        """A table made of ``distinct``, by pair_id, as one of all pairs."""
        return of_distinct

    @cached_property
    def support(self) -> DataFrame:
        return written(self.found)

    @property
    def by_pair(self) -> DataFrame:
        """The supports dealt by pair: what is made of a pair's supports needs no further exchange."""
        return self.support.repartition("pair_id")

    @property
    def triangles(self) -> DataFrame:
        return support.triangles(self.support)

    @cached_property
    def flips(self) -> DataFrame:
        """pair_id, triangle_id, side, mask, flip, asked; what a subset makes of a pair follows from the supports."""
        if self.strategy == "levels":
            out = lattice.monotone_flips(self.support, self.vary, self.matcher, keep=written)
        else:
            out = lattice.flips(lattice.perturbed(self.by_pair, self.vary), self.matcher).withColumn("asked", F.lit(1))
        out = out.select("pair_id", "triangle_id", "side", "mask", "flip", "asked")
        return written(out) if self._kept else out

    @property
    def _kept(self) -> bool:
        """Whether flips are kept, as they cost answers or go by levels; else it is cheaper to decide again than to keep and find them."""
        return self.matcher.asks or self.strategy == "levels"

    @cached_property
    def ranking(self) -> DataFrame:
        return written(lattice.ranking(self.flips))

    @property
    def sufficiency(self) -> DataFrame:
        return lattice.sufficiency(self.ranking, self.triangles)

    @property
    def saliency(self) -> DataFrame:
        return lattice.saliency(self.ranking, self.vary or self.names)

    @property
    def summary(self) -> DataFrame:
        return lattice.summary(self.sufficiency)

    @property
    def counterfactuals(self) -> DataFrame:
        names, best = self.vary or self.names, self.summary.select("pair_id", "side", "mask")
        if not self._kept:
            hits = lattice.flips(lattice.at_masks(self.by_pair.join(best, ["pair_id", "side"]), names), self.matcher)
            return lattice.counterfactuals(hits.where("flip = 1").drop("flip"))
        best = self.flips.where("flip = 1").join(best, ["pair_id", "side", "mask"], "left_semi")
        hits = self.support.withColumn("triangle_id", support.triangle_id()).join(best.select("triangle_id", "mask"), "triangle_id")
        return lattice.counterfactuals(lattice.at_masks(hits, names))

    @cached_property
    def first_counterfactuals(self) -> DataFrame:
        """pair_id and the values of each pair's first counterfactual, written once."""
        return written(self.counterfactuals.where("place = 1").select("pair_id", *sides_of(self)))

    @cached_property
    def token_steps(self) -> DataFrame:
        out = token_paths.steps(self.by_pair, self.matcher, self.features, early=self.strategy == "levels")
        return written(out) if self.matcher.asks else out

    @property
    def token_saliency(self) -> DataFrame:
        return token_paths.token_saliency(self.token_steps, self.features)

    @property
    def token_sufficiency(self) -> DataFrame:
        return token_paths.token_sufficiency(self.token_steps)

    @property
    def properties(self) -> DataFrame:
        return lattice.triangle_properties(self.support, self.matcher)

    def two_step(self, k: int = 2, by: str = "saliency") -> Explanation:
        """The same supports, explained by the tokens of the attributes that matter most: the k of each side by saliency, or all that
        the summary of sufficient subsets names (``by="sufficiency"``)."""
        if by == "saliency":
            place = F.row_number().over(Window.partitionBy("pair_id", F.substring("feature", 1, 1)).orderBy(F.desc("saliency"), "feature"))
            chosen = self.saliency.withColumn("_p", place).where(F.col("_p") <= k).select("pair_id", F.col("feature").alias("attribute"))
        else:
            named = self.summary.select("pair_id", F.explode(F.split(lattice.subset_name(F.col("side"), F.col("mask"), self.vary or self.names), "/")).alias("attribute"))
            chosen = named.distinct()
        tokens = written(token_features(self.rows).join(chosen, ["pair_id", "attribute"]).select("pair_id", "feature").distinct())
        out = Explanation(self.rows, self.found, self.names, self.vary, self.matcher, tokens, self.strategy)
        out.support = self.support
        return out


def _of_all(name: str) -> property:
    return property(lambda self: self.told(getattr(self.distinct, name)))


class Shared(Explanation):
    """The explanation of distinct pairs, told of all ``members``: what follows from a pair's values is the same for equal pairs, so it is
    worked out once for them; ``found`` is that of distinct pairs."""

    def __init__(self, rows: DataFrame, distinct: Explanation, members: DataFrame):
        super().__init__(rows, distinct.found, distinct.names, distinct.vary, distinct.matcher, distinct.features, distinct.strategy)
        self.once, self.members = distinct, members

    @property
    def distinct(self) -> Explanation:
        return self.once

    def told(self, of_distinct: DataFrame) -> DataFrame:
        return pair_rows.told(of_distinct, self.members)

    support, flips, ranking = _of_all("support"), _of_all("flips"), _of_all("ranking")
    sufficiency, saliency, summary, counterfactuals = _of_all("sufficiency"), _of_all("saliency"), _of_all("summary"), _of_all("counterfactuals")
    token_steps, token_saliency, token_sufficiency = _of_all("token_steps"), _of_all("token_saliency"), _of_all("token_sufficiency")

    @property
    def triangles(self) -> DataFrame:
        return support.triangles(self.support)  # names the ids of a pair's own records

    @property
    def properties(self) -> DataFrame:
        ids = self.distinct.triangles.select("pair_id", "triangle_id")
        return self.told(ids.join(self.distinct.properties, "triangle_id")).drop("pair_id")

    def two_step(self, k: int = 2, by: str = "saliency") -> Shared:
        return Shared(self.rows, self.once.two_step(k, by), self.members)


def explain(pairs: DataFrame, left: DataFrame, right: DataFrame, n: int = support.TRIANGLES, sample: int | None = None, vary: list[str] | None = None, matcher: Matcher | None = None, augment: str = "on_demand", features: DataFrame | None = None, strategy: str = "all") -> Explanation:
    """Explains what ``matcher`` decides of every pair of ``pairs``(ltable_id, rtable_id, label); sources stay as they are.

    Supports come from the whole sources, or from a sample of each.  ``augment``: ``on_demand`` adds cut copies of a pair's own records
    where supports are too few, ``always`` adds cut copies of all records to the sources, ``no`` does neither.  ``vary`` names the
    attributes of lattices, ``features``(pair_id, feature) the tokens of token paths.

    ``strategy``: ``all`` puts every subset and token step to the matcher; ``levels`` goes through lattices level by level, where all
    subsets of one level flip counts the larger ones as flipped without asking, and ends a pair's token steps at the first that flips
    everywhere.  For a matcher whose flips only grow with the subset, the saliency of attributes is the same."""
    matcher = matcher or SqlMatcher()
    if augment not in ("no", "on_demand", "always"):
        raise ValueError(f"augment is no, on_demand or always, not {augment}")
    if strategy not in ("all", "levels"):
        raise ValueError(f"strategy is all or levels, not {strategy}")
    every = rows = merge(pairs, left, right)
    names = attributes(rows)
    if features is None:  # those are of one pair each
        rows, members = pair_rows.distinct(rows)
    if augment == "always":
        left, right = (with_cuts(s, names) for s in (left, right))
    found = support.supports(rows, left, right, n, sample, matcher, copied=augment == "on_demand")
    e = Explanation(rows, found, names, vary, matcher, features, strategy)
    return e if features is not None else Shared(every, e, members)


def with_cuts(source: DataFrame, names: list[str]) -> DataFrame:
    """A source with the cut copies of its records, under negative ids made of the record's id and the cut."""
    kept = source.select("id", *names)
    cut = support.subsequences(kept, names)
    number = -F.abs(F.xxhash64("id", "attribute", "kind", "n") % F.lit(1 << 62)) - 1
    return kept.withColumn("id", F.col("id").cast("long")).unionByName(cut.withColumn("id", number).select("id", *names))


def sides_of(e: Explanation) -> list[str]:
    return [p + a for p in (L, R) for a in e.names]
