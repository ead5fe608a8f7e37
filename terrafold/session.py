"""What operators ask of a session: a checkpoint folder, shared scratch paths, the package on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests, local runs) a local one is set; on a cluster it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table that a job writes and reads again."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, whatever their working folder and Python path."""
    here = os.path.dirname(os.path.abspath(__file__))
    marker = "_terrafold_shipped"
    if getattr(spark.sparkContext, marker, False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "terrafold.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("terrafold", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    setattr(spark.sparkContext, marker, True)
