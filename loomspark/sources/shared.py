"""Intermediate tables in the folder that the whole cluster shares, for plans that read a step's result more than once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder, else, for a local master only, a temporary folder."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="loomspark-")
    return f"file://{_own}"


class Shared:
    """Tables of one run. ``save`` writes a table and reads it again: the step runs once, and a lost executor costs
    tasks of the current step only. They are removed when the driver's Python ends, since results that read them are lazy."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, f"{root(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.remove)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        to = f"{self.path}/{self.n}-{name}"
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
