"""Session helpers: a session with the settings the engine wants, and checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings a new session gets; a session that exists keeps its own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quillstone", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the cluster's folder for checkpoints, which all executors see."""
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _checkpoints(spark: SparkSession) -> None:
    """Sees that there is a folder for checkpoints: that of ``spark.checkpoint.dir``, or where Spark runs in this one process a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared_checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once, with its lineage cut, to the folder for checkpoints, which all executors see."""
    _checkpoints(spark)
    return df.checkpoint()


#: Rows of a narrow table up to which it is sent to every task.
FEW = 200_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` to be broadcast in a join if it has at most ``rows`` rows, which are counted; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that tasks can import it wherever they run."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_quillstone_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "quillstone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillstone", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._quillstone_shipped = True
