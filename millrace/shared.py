"""The folder that driver and executors share, cuts of lineage in it, and the package for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it isn't set, a local session gets a temporary folder; on a cluster
    that would lie on one machine's disk, so it raises.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _local.get(sc.applicationId)
        if not where:
            where = _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what follows depends on files alone."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/checkpoints")
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless their PYTHONPATH already has it."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or str(home.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in home.rglob("*.py"):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
