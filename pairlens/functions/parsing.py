"""Free-form answers of matchers to decisions, saliency and counterfactuals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which answers hold their parts.
PREDICTION = ("matching", "matching_prediction", "match", "prediction", "same_entity", "entity_resolution", "1", "is_match")
SALIENCY = ("saliency_explanation", "saliency_explanation_table", "2", "saliency")
COUNTERFACTUAL = ("counterfactual_explanation", "counterfactual", "counterfactual_explanation_table", "attribute_counterfactual", "token_counterfactual", "3")


def answer_to_match(answer: Column, again: Column | None = None) -> Column:
    """1 for yes, 0 for no; an unclear answer counts as the second one does, and an unclear second one as no."""
    a = F.regexp_replace(F.lower(F.trim(F.coalesce(answer, F.lit("")))), r"[.!]+$", "")
    yes = a.rlike(r"^yes|yes$") | a.isin("1", "matching", "true")
    no = a.rlike(r"^no|no$") | a.isin("0", "non-matching", "false")
    return F.when(yes, 1).when(no, 0).otherwise(F.lit(0) if again is None else answer_to_match(again))


def json_body(answer: Column) -> Column:
    """The fenced block of an answer, or what lies between its outer braces."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).otherwise(F.when(braces != "", braces))


def first_of(body: Column, names: tuple[str, ...]) -> Column:
    """The first of the named parts of an answer, which may be wrapped in ``answers``."""
    return F.coalesce(*[F.get_json_object(body, p) for n in names for p in (f"$['{n}']", f"$.answers['{n}']")])


def parse_answer(answer: Column) -> Column:
    """struct<prediction int, saliency map<string,double>, counterfactual map<string,string>>; what is missing is null, and any
    prediction but yes, true and 1 is 0."""
    body = json_body(answer)
    said = F.lower(F.trim(first_of(body, PREDICTION)))
    return F.struct(
        F.when(said.isNotNull(), said.isin("yes", "true", "1").cast("int")).alias("prediction"),
        F.from_json(first_of(body, SALIENCY), "map<string,double>").alias("saliency"),
        F.from_json(first_of(body, COUNTERFACTUAL), "map<string,string>").alias("counterfactual"),
    )


def prediction_boolean(text: Column) -> Column:
    """Whether a prediction in words begins with yes or true."""
    return F.lower(F.trim(text)).rlike("^(yes|true)")


def _prefixed(m: Column, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.when(k.startswith(prefix), k).otherwise(F.concat(F.lit(prefix), k)))


def parse_counterfactual(answer: Column, left: Column, right: Column) -> Column:
    """The changed pair that an answer names, as map<string,string>; null if it names none.

    The answer is a JSON object or a Python literal (single quotes, None, True, False), fenced or not, and holds the pair as
    ``record_after`` (one side; the other is that of the maps ``left`` or ``right``), ``counterfactual_record``, ``counterfactual``,
    ``record1`` and ``record2``, or as its own fields."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(json_body(answer), r":\s*None\b", ": null"), r":\s*True\b", ": true"), r":\s*False\b", ": false")
    part = lambda name: F.from_json(F.get_json_object(literal, f"$.{name}"), "map<string,string>")
    after, first, second = part("record_after"), part("record1"), part("record2")
    both = lambda a, b: F.map_from_entries(F.concat(F.map_entries(a), F.filter(F.map_entries(b), lambda x: ~F.array_contains(F.map_keys(a), x["key"]))))
    other = F.when(F.get(F.map_keys(after), F.lit(0)).startswith("rtable_"), _prefixed(left, "ltable_")).otherwise(_prefixed(right, "rtable_"))
    return F.coalesce(
        F.when(after.isNotNull(), both(after, other)), part("counterfactual_record"), part("counterfactual"),
        F.when(first.isNotNull() & second.isNotNull(), both(_prefixed(first, "ltable_"), _prefixed(second, "rtable_"))), F.from_json(literal, "map<string,string>"),
    )


def result_parts(result: Column) -> Column:
    """struct<prediction, saliency, cf> of a result record in JSON: each under its own name, or in ``answer``, or plain, by the names
    that explainers give them."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(result, f"$.{p}") for p in paths])
    return F.struct(
        at("prediction", "answer.matching_prediction", "matching_prediction").alias("prediction"),
        at("saliency", "answer.saliency_explanation", "saliency_explanation").alias("saliency"),
        at("cf", "cfs[0]", "answer.counterfactual_explanation", "counterfactual_explanation").alias("cf"),
    )


def feedback(left: Column, right: Column, names: Column, right_answer: Column, granularity: str = "attribute") -> Column:
    """An instruction from an explained example: attend to the features that mattered, or less so where the answer was wrong."""
    fix = F.when(right_answer, F.lit("")).otherwise(F.lit("less "))
    return F.concat(F.lit("When predicting a pair like "), left, F.lit(" and "), right, F.lit(", pay "), fix, F.lit(f"attention to the following {granularity}s: "), F.array_join(names, ", "))


def marked_parts(answer: Column) -> Column:
    """Few-shot answers: the text after ``prediction:``, ``saliency:`` and ``counterfactual:``."""
    part = lambda name, until: F.nullif(F.trim(F.regexp_extract(answer, rf"(?is){name}:(.*?)(?:{until}|$)", 1)), F.lit(""))
    return F.struct(part("prediction", "saliency:").alias("prediction"), part("saliency", "counterfactual:").alias("saliency"), part("counterfactual", "$").alias("counterfactual"))


def strip_prompt(answer: Column) -> Column:
    """What follows the last special token of an answer."""
    return F.element_at(F.split(F.element_at(F.split(answer, r"\[/INST\]"), -1), r"<\|end_header_id\|>"), -1)


def word_count(text: Column) -> Column:
    """The token accounting of conversations: pieces between single spaces."""
    return F.size(F.split(text, " "))


def saliency_value(value: Column) -> Column:
    """A score as a number: plain, in a list of one, or under ``saliency`` or ``saliency_score``."""
    return F.coalesce(value.try_cast("double"), F.get(F.from_json(value, "array<double>"), F.lit(0)), F.get_json_object(value, "$.saliency").try_cast("double"), F.get_json_object(value, "$.saliency_score").try_cast("double"))


def example_text(left: Column, right: Column, prediction: Column) -> Column:
    """One few-shot example."""
    return F.format_string("record1:%s\nrecord2:%s\nprediction:%s", left, right, F.when(prediction == 1, "yes").otherwise("no"))
