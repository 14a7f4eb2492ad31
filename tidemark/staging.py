"""Tables written once on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is set only where none is and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Staging:
    """The tables of one run.  They last until close(), or until the process ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{os.getpid()}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        _open.add(self)

    def path(self, name: str) -> str:
        path = f"{self.root}/{name}-{len(self.made)}"
        self.made.append(path)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back: cuts the lineage and survives lost executors."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, keep: int = 0) -> None:
        """Remove all tables but the last ``keep``; frames that read them end here."""
        gone = self.made[: len(self.made) - keep]
        for path in gone:
            remove(self.spark, path)
        self.made = self.made[len(gone) :]
        if not self.made:
            remove(self.spark, self.root)


_open: weakref.WeakSet[Staging] = weakref.WeakSet()
_kept: list[Staging] = []


def lasting(spark: SparkSession) -> Staging:
    """A run whose tables a lazily read result needs: they last until the process ends."""
    _kept.append(Staging(spark))
    return _kept[-1]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _end() -> None:
    for run in list(_open):
        try:
            run.close()
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            continue
