"""The shared folder of a cluster, for checkpoints and files that every executor must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it; a folder of our own only where that is unset in a local session, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or None
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship_by_value(module) -> None:
    """Functions and classes of a module travel with the tasks, so workers need not find the package."""
    cloudpickle.register_pickle_by_value(module)
