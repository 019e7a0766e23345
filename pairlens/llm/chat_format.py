"""Chat formatting by schema fingerprint.

A record is a JSON object of any layout.  The hash of its sorted nested field paths is looked up among those of the declared
mappings, which say where the turns are; a layout that matches no fingerprint falls back on the first mapping whose required paths
are all there.  The canonical turns are then rendered with markers, and a loss mask of spans covers the assistant's texts.

    <|turn|>role<|text|>text<|end|>

Escaping puts a backslash before each backslash and inside each control string of this or other common templates, after its first
character.  Every backslash in escaped text then stands before the character it shields, so dropping it restores the text, and no
unescaped marker can come from a text.

Defined cases: null roles and texts are empty; records that are null, no JSON object or of an unknown layout have no turns and the
layout ``unknown``; texts of any length go in whole; repeated rows are formatted each, and repeated turns of a conversation are turns
of their own; an empty table gives no rows; other columns of the input are carried along.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, unused

#: Control strings of common chat templates, as regular expressions that match after the first character was seen.
CONTROL = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|<(?=/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>)|\[(?=/?INST\])|\[(?=/?(?:SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])"
#: A layout: required paths, and the turns as (role or path of the role, path of the text); ``list`` names a list of turns.
MAPPINGS = [
    {"name": "messages", "list": "messages", "role": "role", "text": "content", "paths": ["messages[].content", "messages[].role"]},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value", "paths": ["conversations[].from", "conversations[].value"]},
    {"name": "instruction_input", "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])], "paths": ["input", "instruction", "output"]},
    {"name": "instruction", "turns": [("user", ["instruction"]), ("assistant", ["output"])], "paths": ["instruction", "output"]},
    {"name": "system_prompt", "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])], "paths": ["prompt", "response", "system"]},
    {"name": "prompt_response", "turns": [("user", ["prompt"]), ("assistant", ["response"])], "paths": ["prompt", "response"]},
    {"name": "prompt_completion", "turns": [("user", ["prompt"]), ("assistant", ["completion"])], "paths": ["completion", "prompt"]},
    {"name": "question_answer", "turns": [("user", ["question"]), ("assistant", ["answer"])], "paths": ["answer", "question"]},
]
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def field_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; elements of lists share one path."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _table(mappings: list[dict]) -> dict[str, dict]:
    return {fingerprint(m["paths"]): m for m in reversed(mappings)}


def _as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def to_turns(record: dict, mapping: dict, roles: dict[str, str]) -> list[dict]:
    if "list" in mapping:
        rows = [x if isinstance(x, dict) else {} for x in record.get(mapping["list"]) or []]
        named = [(_as_text(x.get(mapping["role"])), _as_text(x.get(mapping["text"]))) for x in rows]
        return [{"role": roles.get(r, r), "text": t} for r, t in named]
    joined = [(role, "\n".join(t for f in fields if (t := _as_text(record.get(f))))) for role, fields in mapping["turns"]]
    return [{"role": r, "text": t} for r, t in joined if t or r != "system"]


def canonical_turns(df: DataFrame, record: str = "record", mappings: list[dict] = MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """``df`` without ``record``, with ``schema_id``, ``layout`` and ``turns``, which replace columns of those names.  ``roles`` maps
    other names of the roles, as some layouts have them; with none, roles stay as they are."""
    rest = [c for c in df.columns if c not in (record, "schema_id", "layout", "turns")]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("schema_id", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", TURNS)])
    by_print = _table(mappings)

    def one(raw) -> tuple[str | None, str, list[dict]]:
        try:
            value = json.loads(raw)
        except (TypeError, ValueError):
            value = None
        if not isinstance(value, dict):
            return None, "unknown", []
        paths = field_paths(value)
        mapping = by_print.get(key := fingerprint(paths)) or next((m for m in mappings if set(m["paths"]) <= paths), None)
        return (key, mapping["name"], to_turns(value, mapping, roles)) if mapping else (key, "unknown", [])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [one(x) for x in pdf[record]]
            yield pdf[rest].assign(schema_id=[x[0] for x in out], layout=[x[1] for x in out], turns=[x[2] for x in out])

    return df.mapInPandas(batches, schema)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running_sums(lengths: pd.Series) -> pd.Series:
    # SQL's aggregate copies the list for each turn that it appends
    return lengths.map(np.cumsum)


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
    # SQL's substring counts code points from the start of the text for each span
    return pd.Series([None if t is None or at is None else "".join(t[a - 1 : a - 1 + n] for a, n in zip(at, long, strict=True)) for t, at, long in zip(text, starts, lengths, strict=True)], dtype=object)


def render(df: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start from 1, length; in code points of ``formatted``) from ``turns``; they replace
    columns of those names."""
    empty = F.coalesce(F.col("turns"), F.array().cast(TURNS))
    heads, kept = unused(df, "heads"), [c for c in df.columns if c not in ("formatted", "loss_spans")]
    safe = lambda t, c: escape(F.coalesce(t[c], F.lit("")))
    marked = F.transform(empty, lambda t: F.struct(F.concat(F.lit("<|turn|>"), safe(t, "role"), F.lit("<|text|>")).alias("head"), safe(t, "text").alias("text"), (t["role"] == trained).alias("on")))
    small_batches(df.sparkSession)
    df = df.select(*kept).withColumn(heads, marked)
    end = F.length(F.lit("<|end|>"))
    ends = _running_sums(F.transform(heads, lambda t: (F.length(t["head"]) + F.length(t["text"]) + end).cast("long")))
    place = lambda t, at: F.struct((at - end - F.length(t["text"]) + 1).cast("int").alias("start"), F.length(t["text"]).alias("length"), t["on"].alias("on"))
    on = F.filter(F.zip_with(heads, ends, place), lambda x: x["on"])
    spans = F.transform(on, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    text = F.array_join(F.transform(heads, lambda t: F.concat(t["head"], t["text"], F.lit("<|end|>"))), "")
    return df.withColumn("formatted", text).withColumn("loss_spans", spans).drop(heads)


def parse(df: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss_spans`` back: ``parsed`` turns and ``loss_text``."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    turn = F.transform(pieces, lambda x: F.struct(
        unescape(F.substring_index(F.regexp_replace(x, r"^<\|turn\|>", ""), "<|text|>", 1)).alias("role"),
        unescape(F.substring_index(x, "<|text|>", -1)).alias("text"),
    ))
    small_batches(df.sparkSession)
    return df.withColumn("parsed", turn).withColumn("loss_text", unescape(_cut("formatted", F.col("loss_spans.start"), F.col("loss_spans.length"))))


def gather(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversation rows (key, turn, role, text) as one record for each key, rows by turn, then role and text, in the plainest layout
    that holds them: one question and its answer as ``prompt`` and ``response``, with a system text before them as ``system``; one
    that doesn't begin with a user or system turn as ``conversations``; any other as ``messages``.  A conversation is one text in the
    end, so a task holds a whole one; 2 GB is Spark's limit for a text."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    told = rows.groupBy(key).agg(ordered.alias("o"))
    roles, text = F.col("o.role"), lambda i: F.col("o")[i]["text"]
    like = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    renamed = lambda role, content: F.transform("o", lambda x: F.struct(x["role"].alias(role), x["text"].alias(content)))
    record = (
        F.when(like("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(like("system", "user", "assistant") & (text(0) != ""), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(~roles[0].isin("user", "system"), F.to_json(F.struct(renamed("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(renamed("role", "content").alias("messages"))))
    )
    return told.select(key, record.alias("record"))
