"""Structured Streaming over event files and append-only reward traces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import groups as G


def source(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A watermark wants a timestamp with a time zone; event files may hold one without."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value per window and type; what comes later than ``late`` is dropped."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("rows"), F.avg("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("rows"))


def distinct(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of a key within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


#: What the rules of an early stop need of a row, as numbers, and the most rows that one looks at.
TRACE = ("reward_std", "zero_std", "executable_rate", "marker_rate", "multiple_program_rate", "all_wrong", "unstable")
LONGEST = 10


def numbered(trace: DataFrame, key: str, step: str, finite: Sequence[str] = ("loss",)) -> DataFrame:
    """Rows as the rules take them; ``unstable`` where a column of ``finite`` isn't."""
    unstable = F.exists(F.array(*(F.col(c).cast("double") for c in finite)), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return trace.withColumn("unstable", F.coalesce(unstable, F.lit(False))).select(key, F.col(step).cast("long").alias(step), *map(number, TRACE))


def stop_reason(ring: list[tuple], marked: bool) -> str | None:
    """Why to stop after the last of ``ring``, the latest rows of a run (as TRACE) up to ten of them."""
    last = lambda name, n: [r[TRACE.index(name)] for r in ring[-n:]] if len(ring) >= n else None
    tests = [
        (G.UNSTABLE, ring[-1][TRACE.index("unstable")] > 0),
        (G.VARIANCE, (x := last("all_wrong", 5)) is not None and all(x)),
        (G.CONTRACT, (x := last("multiple_program_rate", 3)) is not None and min(x) > 0),
        (G.CONTRACT, marked),
        (G.VARIANCE, (x := last("reward_std", 5)) is not None and max(x) <= G.NO_SPREAD),
        (G.VARIANCE, (x := last("zero_std", 10)) is not None and sum(x) / 10 >= G.ZERO_SHARE),
        (G.CONTRACT, (x := last("executable_rate", 10)) is not None and sum(x) / 10 < G.LEAST_RUNS),
    ]
    return next((reason for reason, holds in tests if holds), None)


def stop_rules(trace: DataFrame, key: str = "run", step: str = "step", finite: Sequence[str] = ("loss",)) -> DataFrame:
    """(key, step, stop) by the rules of ``groups.early_stop``, with a ring of the last ten rows of each run and
    whether a marker was seen as state. Rows of a trigger are taken in order of their step; ``stops.ordered_stops`` takes
    rows that come out of order across triggers."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, marked = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        ring = [tuple(flat[k : k + len(TRACE)]) for k in range(0, len(flat), len(TRACE))]
        out = []
        for s, *row in pd.concat(list(batches)).sort_values(step)[[step, *TRACE]].itertuples(index=False):
            ring = [*ring, tuple(map(float, row))][-LONGEST:]
            marked = marked or ring[-1][TRACE.index("marker_rate")] > 0
            out.append((keys[0], s, stop_reason(ring, marked)))
        state.update(([v for r in ring for v in r], marked))
        yield pd.DataFrame(out, columns=[key, step, "stop"])

    kind = trace.schema[key].dataType.simpleString()
    rows = numbered(trace, key, step, finite)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {step} long, stop string", "ring array<double>, marked boolean", "append", GroupStateTimeout.NoTimeout)


def unfinished(parts: DataFrame, done: DataFrame, key: str, expected: str, rows: str) -> DataFrame:
    """Parts that have fewer rows done than expected; the others are skipped."""
    have = done.groupBy(key).agg(F.sum(rows).alias("_have"))
    return parts.join(have, key, "left").where(F.coalesce("_have", F.lit(0)) < F.col(expected)).drop("_have")


def append_new(batch: DataFrame, done_path: str, keys: list[str]) -> None:
    """For foreachBatch: writes the rows whose key isn't in the table yet, so a repeated batch adds nothing."""
    spark = batch.sparkSession
    try:
        done = spark.read.parquet(done_path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        batch.dropDuplicates(keys).write.parquet(done_path)
        return
    batch.dropDuplicates(keys).join(done, keys, "left_anti").write.mode("append").parquet(done_path)
