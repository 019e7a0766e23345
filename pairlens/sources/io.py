"""Record tables, pair lists, result files and prompt files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import one_each

PAIRS = "ltable_id long, rtable_id long, label int"
RESULT = "id int, ltuple map<string,string>, rtuple map<string,string>, prediction string, label int, saliency map<string,string>, cfs array<map<string,string>>, latency double, conversation string, filter_features array<string>"
RESULTS = f"data array<struct<{RESULT.replace(', ', ',').replace(' ', ':')}>>, total_time double, tokens double, predictions double, avg_latency double"


def read_records(spark: SparkSession, path: str, attributes: list[str], key: str = "id") -> DataFrame:
    """A CSV record table: a long id and attributes as text; blank lines go."""
    schema = ", ".join([f"`{key}` long", *(f"`{a}` string" for a in attributes)])
    return spark.read.schema(schema).option("header", True).csv(path).dropna("all").withColumnRenamed(key, "id")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).option("header", True).csv(path).dropna("all")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A row for each explanation of result files, with the file's name: a ``data`` list or a bare one."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    wrapped = F.when(F.col("value").startswith("["), F.concat(F.lit('{"data":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    return raw.select("file", F.explode(F.from_json(wrapped, RESULTS)["data"]).alias("d")).select("file", "d.*")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table of scalars as CSV files with a header; nested columns become JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select([F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``role::text`` in order."""
    parts = F.split("value", "::")
    return spark.read.text(path).where("value != ''").select(parts[0].alias("role"), F.get(parts, F.lit(1)).alias("content"))


def flat_record(column: str, fields: list[str], prefix: str) -> list[Column]:
    """A nested record as wide columns."""
    return [F.col(f"{column}.{f}").alias(f"{prefix}{f}") for f in fields]


def split_offers(df: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table of offer pairs (``<field>_left``, ``<field>_right``, label) as two record tables keyed by ``id`` and a pair list."""
    side = lambda s: df.select(F.col(f"id_{s}").alias("id"), *[F.col(f"{f}_{s}").alias(f) for f in fields]).dropDuplicates(["id"])
    return side("left"), side("right"), df.select(F.col("id_left").alias("ltable_id"), F.col("id_right").alias("rtable_id"), "label")


def offer_splits(splits: list[DataFrame], fields: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Offer pairs in several splits as two record tables of all of them, a record for each id, and a pair list for each split."""
    parts = [split_offers(df, fields) for df in splits]
    every = lambda i: functools.reduce(DataFrame.unionByName, [p[i] for p in parts])
    return one_each(every(0)), one_each(every(1)), [p[2] for p in parts]


def train_test(pairs: DataFrame, test_share: float = 0.2, seed: str = "split") -> DataFrame:
    """``pairs`` with ``part``: train or test, by a hash of their ids, each label in proportion."""
    h = F.md5(F.concat(F.lit(seed), F.col("ltable_id").cast("string"), F.lit("|"), F.col("rtable_id").cast("string")))
    return pairs.withColumn("part", F.when(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < int(test_share * (1 << 32)), "test").otherwise("train"))
