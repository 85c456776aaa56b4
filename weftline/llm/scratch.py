"""Written intermediate tables, stable row ids and code shipping, shared by the operators of this subpackage.

Intermediates are parquet tables in the folder that the cluster names in ``spark.checkpoint.dir``: every executor
can read them, and losing an executor loses none of them. Only where that setting is absent and Spark runs in one
process (tests, a laptop) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates, without a trailing slash."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or None
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        else:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # already running from a shipped archive
        return
    where = os.path.join(tempfile.mkdtemp(prefix="weftline-code-"), "weftline_code.zip")
    with zipfile.ZipFile(where, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(where)
    _shipped.add(sc.applicationId)


_watched: list[list[Scratch]] = []


@contextlib.contextmanager
def swept():
    """Deletes at its end what operators called inside have written for themselves; their results must be written by then."""
    made: list[Scratch] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
        for one in made:
            one.close()
            atexit.unregister(one.close)
        if made:
            made[0].sweep()


class Scratch:
    """A folder of written tables for one call of an operator.

    ``keep`` writes a frame and reads it back, which cuts its lineage. ``drop`` deletes a table that nothing needs
    any more; what remains goes when the application ends, since results that have not yet run may read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/weftline/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for made in _watched:
            made.append(self)
        atexit.register(self.close)

    def new_path(self, what: str = "t") -> str:
        self.count += 1
        return f"{self.path}/{what}{self.count}"

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = self.new_path()
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._delete(df._weftline_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def sweep(self) -> None:
        """Lets the driver drop what it no longer refers to, so that executors delete the shuffle files of written tables.

        The plan of the last write goes with the second collection only, once the first has let go of what holds it.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def close(self) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None and sc._gateway is not None:
            try:
                self._delete(self.path)
            except Exception:  # the JVM has gone first; the folder is the cluster's to clean
                pass


#: Plans of these nodes alone give the same rows at the same places each time they run.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "SubqueryAlias", "View", "DataSourceV2ScanRelation"}


def _steady(plan) -> bool:
    name = plan.getClass().getSimpleName()
    below = plan.children()
    return name in _STEADY and plan.deterministic() and all(_steady(below.apply(i)) for i in range(below.size()))


def with_row_id(df: DataFrame, scratch: Scratch, name: str = "_row") -> DataFrame:
    """``df`` with a long that is unique per row and the same each time the frame is evaluated.

    Ids from partition number and position are stable when the plan only scans and projects, as file splits do not
    change between evaluations. Any other plan is written first. A column of that name is replaced.
    """
    if not _steady(df._jdf.queryExecution().optimizedPlan()):
        df = scratch.keep(df)
    return df.withColumn(name, F.monotonically_increasing_id())


def boxed(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``documents`` as one struct column ``_doc`` beside ``_row``, so that no name of theirs can clash with a working one."""
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]
    return with_row_id(documents.select(F.struct(*cols).alias("_doc")), scratch)


def unboxed(boxes: DataFrame, documents: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``documents`` again, in their order; ``new`` holds those that change."""
    return boxes.select(*[(new or {}).get(c, F.col("_doc").getField(c)).alias(c) for c in documents.columns])


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
