"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: What an Arrow batch to a Python worker may hold, unless the application sets it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for long texts and long lists."""
    given = spark.sparkContext.getConf()
    for key, most in BATCH.items():
        if not given.contains(key):
            spark.conf.set(key, most)
    return spark


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder. Without either a private
    temporary folder serves a local master; a cluster has no other folder that all of it sees."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="loomspark-")
    return f"file://{_own}"


class Scratch:
    """A folder for one run of an operator. ``save`` writes a table and reads it again, which cuts
    the lineage: a lost executor costs the tasks of the current step, not the steps before it.

    The folder lives until the driver's Python ends, since the results that read it are lazy.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = bounded(spark)
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self._saved: dict[str, int] = {}
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        n = self._saved[name] = self._saved.get(name, -1) + 1
        to = self.path(f"{name}-{n}")
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str, keep: int = 1) -> None:
        """Removes all but the last ``keep`` versions of a saved table."""
        for n in range(self._saved.get(name, -1) + 1 - keep):
            self._delete(self.path(f"{name}-{n}"))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are saved by now; it does so when
        the driver's JVM collects its garbage, which may be late."""
        gc.collect()
        with contextlib.suppress(Exception):
            self.spark._jvm.System.gc()

    def remove(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
