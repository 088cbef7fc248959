"""Session-level helpers shared by every operator."""

from __future__ import annotations

import functools
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a single-machine master gets a folder of its own when the setting is
    missing; on a cluster a machine-local folder would lose data with its host.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="deskloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once and forgets its lineage."""
    path = shared_dir(df.sparkSession)
    ship(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


#: Rows up to which a table counts as small.
SMALL = 10_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is for the planner to decide."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@functools.cache
def _package() -> str:
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="deskloom-package-")) / "deskloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return str(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application; Spark serves the file from the driver."""
    if spark.sparkContext.applicationId not in _shipped:
        spark.sparkContext.addPyFile(_package())
        _shipped.add(spark.sparkContext.applicationId)
