"""Matchers: anything that scores pair rows with ``match_score`` and ``nomatch_score``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..written import written
from .calls import TRIES, WAIT, AnswerStore, Caller, Counts, key, spread
from .pairs import L, R, attributes


class Matcher:
    """``score`` adds the two scores to pair rows; all else follows from it.  ``counts``: what has been asked, if the matcher keeps it.
    ``asks``: whether a decision is worth keeping, as it costs more than to read it again."""

    counts: Counts | None = None
    asks: ClassVar[bool] = True

    def score(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def decide(self, rows: DataFrame, left: list[Column], right: list[Column], names: list[str], out: str) -> DataFrame:
        """``rows`` with ``out``: 1 where the records ``left`` and ``right`` (a column for each of ``names``) match by a score above
        one half, 0 below it, and null at one half, as of a failure.  Equal pairs of records are asked once."""
        sides = {L + n: c.cast("string") for n, c in zip(names, left, strict=True)} | {R + n: c.cast("string") for n, c in zip(names, right, strict=True)}
        keyed = rows.withColumn("_ask", key(*sides.values()))
        asked = keyed.groupBy("_ask").agg(*[F.first(v).alias(c) for c, v in sides.items()], F.count("*").alias("_n"))
        decided = F.when(F.col("match_score") > 0.5, 1).when(F.col("match_score") < 0.5, 0)
        answers = written(self.score(asked).select("_ask", "_n", decided.alias(out)))
        if self.counts is not None:  # score has counted the distinct ones
            self.counts.rows += answers.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
        return spread(keyed, answers, "_ask", "_n").drop("_ask")


def sides(rows: DataFrame) -> tuple[list[Column], list[Column], list[str]]:
    """What ``decide`` takes for pair rows as they are."""
    names = attributes(rows)
    return [F.col(L + n) for n in names], [F.col(R + n) for n in names], names


def token_match(left: list[Column], right: list[Column]) -> Column:
    """1 if the token sets of two records share at least half of their union, in whole numbers."""
    a, b = tokens(*left), tokens(*right)
    return (2 * F.size(F.array_intersect(a, b)) >= F.size(F.array_union(a, b))).cast("int")


@dataclass
class SqlMatcher(Matcher):
    """A column expression: the plan holds no Python."""

    asks: ClassVar[bool] = False
    rule: Callable[[list[Column], list[Column]], Column] = token_match

    def score(self, rows: DataFrame) -> DataFrame:
        names = attributes(rows)
        out = rows.withColumn("match_score", self.rule([F.col(L + n) for n in names], [F.col(R + n) for n in names]).cast("double"))
        return out.withColumn("nomatch_score", 1 - F.col("match_score"))

    def decide(self, rows: DataFrame, left: list[Column], right: list[Column], names: list[str], out: str) -> DataFrame:
        score = F.col("_score")  # named, so it is computed once
        return rows.withColumn("_score", self.rule(left, right)).withColumn(out, F.when(score > 0.5, 1).when(score < 0.5, 0)).drop("_score")


@dataclass
class PandasMatcher(Matcher):
    """A Python function of a frame of distinct pairs to match scores.  Each distinct pair is asked once; where the function fails, down
    to a single pair and after several tries, that pair scores one half, which later filters leave out.  The function runs within tasks,
    so it may call a model or a service.  With ``cache``, a folder, answers are kept there and pairs that it knows are never asked again."""

    predict: Callable[[pd.DataFrame], pd.Series]
    cache: str | None = None
    tries: int = TRIES
    wait: float = WAIT
    counts: Counts = field(default_factory=Counts)

    def score(self, rows: DataFrame) -> DataFrame:
        columns, predict = [p + n for p in (L, R) for n in attributes(rows)], self.predict

        def call(pdf: pd.DataFrame) -> pd.Series:
            return predict(pdf).astype(float)

        out = Caller(call, AnswerStore(self.cache) if self.cache else None, self.tries, self.wait, self.counts)(rows, columns)
        out = out.withColumn("match_score", F.coalesce(F.col("_answer").cast("double"), F.lit(0.5))).withColumn("status", F.col("_status"))
        return out.drop("_answer", "_status").withColumn("nomatch_score", 1 - F.col("match_score"))


def f1(rows: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: tp, fp, fn and the F1 score; rows without a label or prediction are left out."""
    y, p = F.col(label), F.col(predicted)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = rows.where(y.isNotNull() & p.isNotNull()).agg(n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 1) & (p == 0)).alias("fn"))
    return sums.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
