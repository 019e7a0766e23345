"""Tables written on the way, in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster without one is an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pairlens-")
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet, computed once, whoever reads it afterwards and how often."""
    path = f"{shared_dir(df.sparkSession)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
