"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results rest on."""
    ship_path()
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("pairlens")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory).config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def ship_path() -> None:
    """Python workers of a session that starts later find the package where this process does."""
    top = str(Path(__file__).resolve().parent.parent)
    if top not in (old := os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        os.environ["PYTHONPATH"] = f"{top}{os.pathsep}{old}"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of a running session, once."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    if str(top.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return  # as on clusters where it is installed
    at = Path(tempfile.mkdtemp(prefix="pairlens-")) / "pairlens.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
