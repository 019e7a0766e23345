"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word where a contract says so: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a local session (tests) gets a
    folder of its own; a cluster has none that all executors see, so that is an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pairlens-")
    return _own[app]


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, and outlives executors.  Unlike
    ``checkpoint()`` it computes ``df`` once and keeps columns prunable.  Inside ``temporary`` the table is deleted at the end, unless it is
    to be kept."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``durable`` writes inside, at the end: results must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Bounds what a Python task holds at once: so many rows, and so many bytes (a longer row comes alone).  The words of a batch take
    some ten times its bytes.  Spark reads these settings when a plan runs, which is after an operator has returned it, so they stay
    set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def fraction(seed: int, *keys: str) -> Column:
    """A reproducible number in [0, 1) for each value of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns, 128 bits in all: rows of equal hashes are equal in every column."""
    empty = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns])  # hashes pass over nulls
    return tuple(F.xxhash64(F.lit(seed), empty, *[F.col(f"`{c}`") for c in df.columns]) for seed in (1, 2))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once for each row.  A plain projection may be copied by the optimizer into filters and
    into the bodies of lambdas, where a split text would be split again for each element; it copies nothing through a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def spread_join(rows: DataFrame, few: DataFrame, on: str | list[str], count: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row for each value of ``on`` and in ``count`` how many rows have it.  Values
    that have over 1/``hot`` of all rows, of which there are fewer than ``hot``, are joined by broadcast, so no task gets all rows of
    one; the rest by shuffle.  Both inputs are read twice: pass written tables."""
    on = [on] if isinstance(on, str) else on
    total = few.agg(F.sum(count)).first()[0] or 0
    many = F.broadcast(few.where(F.col(count) > total / hot).drop(count))
    rest = rows.join(many.select(*on), on, "left_anti").join(few.where(F.col(count) <= total / hot).drop(count), on)
    return rows.join(many, on).unionByName(rest)
