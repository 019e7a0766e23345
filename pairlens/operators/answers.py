"""Explainers that ask: a model, or any function of conversations, decides a pair and explains itself, or judges explanations.

The function gets a series of conversations, each a JSON list of {role, content}, and gives a series of texts; it runs within tasks, so
it may call a service.  Each distinct conversation is asked once, and with a store never again; where it fails the answer is empty."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..sources import prompts
from ..written import written
from .calls import AnswerStore, Caller, Counts, key, spread
from .matchers import Matcher
from .pairs import L, R, attributes, tuple_of

Answer = Callable[[pd.Series], pd.Series]
MESSAGES = "array<struct<role:string,content:string>>"


def ask(df: DataFrame, conversation: str, out: str, answer: Answer, store: AnswerStore | None = None, counts: Counts | None = None, distinct: bool = False) -> DataFrame:
    """``df`` with the answers to its column of conversations; an empty answer where all tries failed.  ``distinct``: all of them
    differ, and ``_n`` has how many rows ask each, so they are neither grouped nor joined back."""

    def call(pdf: pd.DataFrame) -> pd.Series:
        return answer(pdf["_asked"]).astype(str)

    asked = df.withColumn("_asked", F.to_json(conversation))
    caller = Caller(call, store, counts=Counts() if counts is None else counts)
    told = caller.told(asked, ["_asked"])[0] if distinct else caller(asked, ["_asked"])
    return told.withColumn(out, F.coalesce("_answer", F.lit(""))).drop("_asked", "_answer", "_status")


def filled(template: list[tuple[str, str]], **values: Column) -> Column:
    """A conversation with its places filled in."""
    def content(text: str) -> Column:
        out = F.lit(text)
        for name, value in values.items():
            if f"{{{name}}}" in text:
                out = F.replace(out, F.lit(f"{{{name}}}"), value)
        return out

    return F.array(*[F.struct(F.lit(role).alias("role"), content(text).alias("content")) for role, text in template])


def said(conversation: Column, role: str, text: Column) -> Column:
    return F.concat(conversation, F.array(F.struct(F.lit(role).alias("role"), text.alias("content"))))


def words_of(conversation: Column) -> Column:
    """The accounting of tokens: words of all messages."""
    return F.aggregate(conversation, F.lit(0), lambda n, m: n + parsing.word_count(m["content"]))


def scores(saliency: Column) -> Column:
    """A JSON object of scores, plain, in lists or under ``saliency`` or ``saliency_score``, as map<string,double>."""
    parts = F.from_json(saliency, "map<string,string>")
    return F.transform_values(parts, lambda _, v: parsing.saliency_value(v))


@dataclass
class SelfExplainer(Matcher):
    """``explain`` asks once for decision, saliency and counterfactual; ``explain_turns`` asks for them one after the other, with a
    reason between; ``explain_few_shot`` shows examples first.  All add prediction, saliency, cf, conversation and tokens to pair rows."""

    answer: Answer
    granularity: str = "attribute"
    store: AnswerStore | None = None
    counts: Counts = field(default_factory=Counts)

    def _led(self, rows: DataFrame, opened: Column, talk: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with what ``talk`` adds to distinct conversations, which begin as ``opened``: equal ones are led once, all turns of
        them, and rows meet them at the end.  Rows' own columns of the same names go."""
        keyed = written(rows.withColumn("conversation", opened).withColumn("_led", key(F.to_json("conversation"))))
        kinds = written(keyed.groupBy("_led", "conversation").agg(F.count("*").alias("_n")))
        talked = talk(kinds)
        new = [c for c in talked.columns if c not in ("_led", "_n")]
        out = spread(keyed.drop(*new), talked, "_led", "_n")
        return out.select(*rows.columns, *[c for c in new if c not in rows.columns])

    def _ask(self, led: DataFrame, out: str) -> DataFrame:
        """Distinct conversations, each with the answer to it at its end and as ``out``."""
        told = ask(led, "conversation", out, self.answer, self.store, self.counts, distinct=True)
        return told.withColumn("conversation", said(F.col("conversation"), "assistant", F.col(out)))

    def _tuples(self, rows: DataFrame) -> dict[str, Column]:
        names = attributes(rows)
        return {"ltuple": F.to_json(tuple_of(L, names)), "rtuple": F.to_json(tuple_of(R, names)), "feature": F.lit(self.granularity)}

    def _opened(self, rows: DataFrame, more: Column | None = None) -> Column:
        """A conversation that asks for a decision."""
        parts = (filled(prompts.DECIDE, **self._tuples(rows)), more, filled([prompts.QUESTION], **self._tuples(rows)))
        return F.concat(*[c for c in parts if c is not None])

    def _decided(self, led: DataFrame) -> DataFrame:
        """Adds ``prediction`` to distinct conversations; only what is unclear is asked again."""
        first, text = self._ask(led, "_first"), parsing.strip_prompt(F.col("_first"))
        clear = parsing.answer_to_match(text, F.lit("yes")) == parsing.answer_to_match(text, F.lit("no"))
        sure = first.where(clear).withColumn("prediction", parsing.answer_to_match(text))
        again = first.where(~clear).withColumn("conversation", said(F.col("conversation"), *prompts.AGAIN[:1], F.lit(prompts.AGAIN[1])))
        again = self._ask(again, "_second")
        again = again.withColumn("prediction", parsing.answer_to_match(parsing.strip_prompt(F.col("_second")))).drop("_second")
        return sure.unionByName(again).drop("_first")

    def predict(self, rows: DataFrame, more: Column | None = None) -> DataFrame:
        """``more``: messages put before the question, such as feedback from explained examples."""
        return self._led(rows, self._opened(rows, more), self._decided).withColumn("tokens", words_of(F.col("conversation")))

    def score(self, rows: DataFrame) -> DataFrame:
        out = self._led(rows, self._opened(rows), self._decided).withColumn("match_score", F.col("prediction").cast("double")).drop("conversation", "prediction")
        return out.withColumn("nomatch_score", 1 - F.col("match_score"))

    def explain(self, rows: DataFrame) -> DataFrame:
        out = self._led(rows, filled([*prompts.ONE_SHOT, prompts.QUESTION], **self._tuples(rows)), lambda led: self._ask(led, "_a"))
        body = parsing.json_body(parsing.strip_prompt(F.col("_a")))
        names = attributes(rows)
        out = out.withColumn("_p", parsing.parse_answer(parsing.strip_prompt(F.col("_a"))))
        cf = parsing.parse_counterfactual(parsing.first_of(body, parsing.COUNTERFACTUAL), tuple_of(L, names), tuple_of(R, names))
        out = out.withColumns({"prediction": F.col("_p.prediction"), "saliency": scores(parsing.first_of(body, parsing.SALIENCY)), "cf": cf})
        return out.withColumn("tokens", words_of(F.col("conversation"))).drop("_a", "_p")

    def explain_turns(self, rows: DataFrame) -> DataFrame:
        names = attributes(rows)

        def talk(led: DataFrame) -> DataFrame:
            led = self._decided(led)
            for name, turn in (("why", prompts.WHY), ("_saliency", prompts.SALIENCY), ("_cf", prompts.COUNTERFACTUAL)):
                led = self._ask(led.withColumn("conversation", F.concat("conversation", filled([turn], feature=F.lit(self.granularity)))), name)
            return led

        out = self._led(rows, self._opened(rows), talk)
        cf = parsing.parse_counterfactual(parsing.strip_prompt(F.col("_cf")), tuple_of(L, names), tuple_of(R, names))
        out = out.withColumns({"saliency": scores(parsing.json_body(parsing.strip_prompt(F.col("_saliency")))), "cf": cf})
        return out.withColumn("tokens", words_of(F.col("conversation"))).drop("_saliency", "_cf")

    def explain_few_shot(self, rows: DataFrame, examples: DataFrame) -> DataFrame:
        """``examples``: a few rows (ltuple, rtuple, prediction, saliency, cf) of texts, shown in that order."""
        shown = []
        for e in examples.orderBy("ltuple", "rtuple").collect():  # the examples of a prompt
            shown += [(role, text.replace("{ltuple}", e["ltuple"]).replace("{rtuple}", e["rtuple"]).replace("{prediction}", str(e["prediction"])).replace("{saliency}", e["saliency"]).replace("{cf}", e["cf"])) for role, text in prompts.FEW_SHOT]
        plain = {k: F.translate(v, "\"'", "") for k, v in self._tuples(rows).items()}
        opened = F.concat(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in [prompts.ROLE, *shown]]), filled([("human", prompts.FEW_SHOT[0][1])], **plain))
        out = self._led(rows, opened, lambda led: self._ask(led, "_a"))
        out = out.withColumn("_p", parsing.marked_parts(F.col("_a")))
        decided = F.trim(F.regexp_extract(F.coalesce("_p.prediction", F.lit("")), "^[^,]*", 0))
        part = lambda c: F.replace(F.regexp_extract(F.coalesce(F.col(f"_p.{c}"), F.lit("")), r"(?s)^[^}]*\}", 0), F.lit("'"), F.lit('"'))
        out = out.withColumns({"prediction": F.when(decided.isin("0", "1"), decided.cast("int")).otherwise(parsing.answer_to_match(F.col("_a"))), "saliency": scores(part("saliency")), "cf": F.from_json(part("counterfactual"), "map<string,string>")})
        return out.withColumn("tokens", words_of(F.col("conversation"))).drop("_a", "_p")


def judged(both: DataFrame, first: str, second: str, answer: Answer, seed: str = "judge") -> DataFrame:
    """``both``(id, ltuple, rtuple, prediction and two columns of explanations) with ``pick``: the name of the column that a judge
    prefers, or none.  Which one is shown first is drawn by a hash of the id, so a judge's leaning to a place evens out."""
    swap = F.pmod(F.crc32(F.concat(F.lit(seed), F.col("id").cast("string"))), F.lit(2)) == 1
    shown = {"ltuple": F.col("ltuple"), "rtuple": F.col("rtuple"), "prediction": F.col("prediction").cast("string"), "explanation1": F.when(swap, F.col(second)).otherwise(F.col(first)), "explanation2": F.when(swap, F.col(first)).otherwise(F.col(second))}
    out = ask(both.withColumn("_c", filled(prompts.JUDGE, **shown)), "_c", "_said", answer)
    one, two = F.lower("_said").contains("system1"), F.lower("_said").contains("system2")
    pick = F.when(one & ~two, F.when(swap, F.lit(second)).otherwise(F.lit(first))).when(two & ~one, F.when(swap, F.lit(first)).otherwise(F.lit(second))).otherwise(F.lit("none"))
    return out.withColumn("pick", pick).drop("_c", "_said")
