"""Calls of a matcher or model: each distinct question once, failures down to the row that fails, answers kept, calls counted.

A function gets a frame of questions and gives a series of answers; it runs within tasks, so it may call a service.  Where it fails on
several rows, halves are asked until the row is found, so the rows beside a bad one are answered; a row that fails alone is asked again, after a
wait that doubles and varies, and at last counts as failed.  After ``GIVE_UP`` rows in a row that failed, the rest of a batch is not asked: the
service is down, and what has no answer is asked again by the next run that shares the store.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..written import written

#: Rows of a batch at most, tries of a row that fails, the first wait in seconds, and failures in a row that end a batch.
ROWS, TRIES, WAIT, GIVE_UP = 1000, 3, 0.05, 20
#: A question of over one row in so many is hot: its rows are dealt over several tasks.
HOT = 1000


@dataclass
class Counts:
    """What has been asked so far: rows, distinct questions, those that the store knew, and those that failed."""

    rows: int = 0
    distinct: int = 0
    known: int = 0
    failed: int = 0


def _tried(questions: pd.DataFrame, call: Callable[[pd.DataFrame], pd.Series], tries: int, wait: float) -> tuple[list | None, list[str]]:
    """The answers of the first try that gives some, if any does, and why those before it failed."""
    failed: list[str] = []
    for attempt in range(tries):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1) * (0.5 + random.random()))
        try:
            said = list(call(questions))
            if len(said) != len(questions):
                raise ValueError("not one answer for each question")
            return said, failed
        except Exception as e:  # noqa: BLE001  a matcher may fail in any way; the row tells how
            failed.append(f"failed: {type(e).__name__}")
    return None, failed


def answered(questions: pd.DataFrame, call: Callable[[pd.DataFrame], pd.Series], tries: int = TRIES, wait: float = WAIT) -> tuple[list, list[str]]:
    """(answers, status) of each row: ``ok``, or ``failed:`` and why, with no answer.

    Rows are asked in order, ``step`` at once.  Where that fails, halves lead to the first row that fails: if the first half is answered, it
    is in the second, which is not asked whole.  The rows after it are open again, and as many are asked at once as were answered so."""
    answers: list = [None] * len(questions)
    status = ["failed: not asked"] * len(questions)
    failures = 0
    step = most = len(questions)
    start, bad, group = 0, 0, 0  # rows before start are done; of those from start to bad, if there are any, one fails
    while start < len(questions) and failures < GIVE_UP:
        searching = bad > start
        size = (bad - start + 1) // 2 if searching else min(step, len(questions) - start)
        end, group = start + size, group if searching else start
        said, failed = _tried(questions.iloc[start:end], call, tries if size == 1 else 1, wait)
        if said is not None:
            answers[start:end], status[start:end] = said, ["ok"] * size
            failures = 0
        elif size == 1:
            status[start] = failed[-1]
            failures += 1
        if failed and start == group:
            step = max(1, size // 2)
        elif searching and end == bad and not failed:  # none of these rows fails, so it was their number
            most = step
        elif not searching:
            step = min(most, 2 * size)
        if failed and size > 1:
            bad = end
        else:
            start = end
            bad = start if failed else bad
    return answers, status


@dataclass
class AnswerStore:
    """Answers of earlier runs, in a folder that driver and executors share.  Each run adds a table of its own, which counts once it is
    whole; of failures nothing is known, so they are asked again.  ``compact`` rewrites all tables as one and deletes them, which
    other runs must not read at that time."""

    path: str

    def _parts(self, spark: SparkSession) -> list[str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def known(self, spark: SparkSession) -> DataFrame:
        """(key, answer, status), one row for each question that was ever answered."""
        schema = "key string, answer string, status string"
        parts = self._parts(spark)
        rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
        return rows.where("status = 'ok'").groupBy("key").agg(F.min("answer").alias("answer"), F.lit("ok").alias("status"))

    def add(self, answers: DataFrame) -> DataFrame:
        """Adds (key, answer, status) and gives it back as written."""
        part = f"{self.path}/answers-{uuid.uuid4().hex}"
        answers.write.parquet(part)
        return answers.sparkSession.read.schema(answers.schema).parquet(part)

    def compact(self, spark: SparkSession) -> None:
        parts = self._parts(spark)
        self.add(self.known(spark))
        for p in parts:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def key(*columns: Column) -> Column:
    """The name of a question: its columns, nulls told from texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), c), F.lit("0")) for c in columns]), 256)


def spread(rows: DataFrame, few: DataFrame, on: str, count: str, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``few``, which has a row for each ``on`` and in ``count`` how many rows have it; ``total``: their sum,
    if it is known.  The rows of a hot one, of which there are fewer than ``HOT``, are dealt over as many tasks as its share asks for."""
    if total is None:
        total = few.agg(F.sum(count)).first()[0] or 0
    parts = F.ceil(F.col(count) * HOT / max(1, total)).cast("long")
    hot = F.broadcast(few.where(parts > 1).select(on, parts.alias("_parts")))
    dealt = rows.join(hot, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts")))).drop("_parts")
    copied = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(count)
    return dealt.join(copied.hint("merge"), [on, "_part"]).drop("_part")  # packed, many questions look few: they must not go through the driver


@dataclass
class Caller:
    """A function of frames of questions, how often to try, where answers are kept, and what has been asked."""

    call: Callable[[pd.DataFrame], pd.Series]
    store: AnswerStore | None = None
    tries: int = TRIES
    wait: float = WAIT
    counts: Counts = field(default_factory=Counts)

    def __call__(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with ``_answer`` (a text) and ``status``.  The questions are the distinct values of the columns, which are texts; the
        function sees them under their names.  Answers are written before this returns, so nothing is asked twice."""
        keyed = written(rows.withColumn("_key", self._key(columns)))  # read twice
        texts = [c for c in columns if keyed.schema[c].dataType == StringType()]  # equal where keys are, and grouped by without a sort
        asked = keyed.groupBy("_key", *[F.col(f"`{c}`") for c in texts]).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in columns if c not in texts], F.count("*").alias("_n"))
        told, total = self.told(written(asked), columns)
        return spread(keyed, told, "_key", "_n", total).drop("_key")

    def _key(self, columns: list[str]) -> Column:
        return key(*[F.col(f"`{c}`").cast("string") for c in columns])

    def told(self, asked: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
        """Distinct questions, of which ``_n`` has how many rows ask them, with ``_answer`` and ``_status`` in place of the columns, written;
        and the number of rows.  Their other columns are not sent to the function."""
        spark, call, tries, wait = asked.sparkSession, self.call, self.tries, self.wait

        def answers(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                said, status = [], []
                for a in range(0, len(pdf), ROWS):
                    part = answered(pdf.iloc[a : a + ROWS].reset_index(drop=True), call, tries, wait)
                    said += [None if x is None else str(x) for x in part[0]]
                    status += part[1]
                yield pd.DataFrame({"answer": pd.Series(said, dtype=object), "status": pd.Series(status, dtype=object)})

        put = F.pandas_udf(answers, "answer string, status string").asNondeterministic()
        new = asked
        if self.store is not None:
            asked = asked.withColumn("_question", self._key(columns))
            known = self.store.known(spark).withColumnRenamed("key", "_question")
            new = asked.join(known.select("_question"), "_question", "left_anti")
        seen = Observation()
        new = new.withColumn("_told", put(F.struct(*[F.col(f"`{c}`") for c in columns])))
        new = new.observe(seen, F.count("*").alias("asked"), F.count_if(F.col("_told.status") != "ok").alias("failed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
        told = new.withColumns({"_answer": F.col("_told.answer"), "_status": F.col("_told.status")}).drop("_told", *columns)
        if self.store is None:
            told = written(told)
            distinct, rows = seen.get["asked"], seen.get["rows"]
        else:
            now = self.store.add(told.select(F.col("_question").alias("key"), F.col("_answer").alias("answer"), F.col("_status").alias("status"))).withColumnRenamed("key", "_question")
            every = now.unionByName(known.join(now.select("_question"), "_question", "left_anti"))
            told = written(asked.drop(*columns).join(every.withColumnsRenamed({"answer": "_answer", "status": "_status"}).hint("merge"), "_question").drop("_question"))
            distinct, rows = told.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        self.counts.rows += rows
        self.counts.distinct += distinct
        self.counts.known += distinct - seen.get["asked"]
        self.counts.failed += seen.get["failed"]
        return told, rows
