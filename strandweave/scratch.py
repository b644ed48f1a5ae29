"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back.  The folder is the
session's ``spark.checkpoint.dir``; where that is unset on one machine (tests, a laptop) a new local one is
made, and on a cluster that is an error.  :func:`release` deletes what finished operators have left.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Seconds after which the shuffle files of finished steps are given up.
CLEAN_S = 3


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one only if the session names none."""
    base = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{KEY} is unset: name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(KEY, base)
    return base.rstrip("/")


#: Runs whose tables are not deleted yet.
OPEN: list[Scratch] = []


def release() -> None:
    """Deletes the tables of all operators so far; results that were not read or written yet are lost."""
    while OPEN:
        OPEN.pop().delete()


atexit.register(release)


class Scratch:
    """Tables of one run of an operator, in a folder of their own below the shared one.

    ``keep`` writes a table and returns it read back; ``drop`` deletes one that no later step reads.
    What is left is deleted by :func:`release` or when the driver ends, since results are read lazily.
    """

    cleaned = 0.0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        OPEN.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        if time.monotonic() > Scratch.cleaned + CLEAN_S:
            # else the shuffle files of all steps so far stay until the driver happens to collect its garbage
            self.spark.sparkContext._jvm.System.gc()
            Scratch.cleaned = time.monotonic()
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "scratch_path", None)
        if path:
            self._delete(path)

    def delete(self) -> None:
        """Deletes all tables of this run."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has ended: the cluster clears its scratch folder
            pass
