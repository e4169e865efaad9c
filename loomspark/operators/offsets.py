"""Running sums and the lowest rows of groups of any size, without a window over a group.

Sums: rows are partitioned by ranges of (group, order), summed up within their range, and shifted by the sums of the ranges before; a group that holds most of a table is
in many ranges. Lowest rows: a histogram of each group's hash by its leading hex digits finds the bucket in which the n-th row lies; that bucket alone is refined, until
it is small enough to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Shared

#: Hex digits a refinement, and rows of a bucket that are ranked.
DIGITS, LEAF = 3, 1024
#: Groups up to which their thresholds are broadcast.
BROADCAST_GROUPS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_GROUPS) -> DataFrame:
    """``df``, to be broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running(df: DataFrame, group: Column, order: str, size: Column, shared: Shared) -> DataFrame:
    """(g: struct<group>, order, n, at, total): of every order of a group the sum of ``size``, the sum before it and that of the whole group.

    Nulls are a group, and a null order comes first. Rows that share group and order count together."""
    rows = df.select(F.struct(group.alias("v")).alias("g"), F.col(order), size.cast("long").alias("n")).groupBy("g", order).agg(F.sum("n").alias("n"))
    rows = shared.save(rows.repartitionByRange("g", order).withColumn("range", F.spark_partition_id()), "ranges")
    runs = rows.groupBy("range", "g").agg(F.sum("n").alias("sum"))
    w = Window.partitionBy("g")  # a row a range
    before = F.coalesce(F.sum("sum").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = shared.save(runs.select("range", "g", before.alias("before"), F.sum("sum").over(w).alias("total")), "runs")
    inside = F.sum("n").over(Window.partitionBy("range", "g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("inside", inside).join(small(runs), ["range", "g"]).select("g", order, "n", (F.col("before") + F.col("inside")).alias("at"), "total")


def mark_lowest(df: DataFrame, strata: list[str], wanted: DataFrame, key: Column, ids: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first of its stratum by (key, ids), as many as ``wanted`` (strata, quota) says.

    ``key`` is lower-case hex, spread evenly, like ``sampling.order_key``; ids tell rows apart. Actions run while the plan is built."""
    shared = Shared(df.sparkSession, "lowest")
    s = [f"_s{i}" for i in range(len(strata))]
    named = lambda d, *more: d.select(*(F.col(c).alias(a) for c, a in zip(strata, s, strict=True)), *more)
    narrow = shared.save(named(df, key.alias("_key")), "keys")
    edge = shared.save(named(wanted, F.lit("").alias("_prefix"), F.col("quota").cast("long").alias("_need"), F.lit(None).cast("long").alias("_n")), "edge")

    def joined(rows: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
        e = side.select(*(F.col(a).alias(f"{a}e") for a in s), *[c for c in side.columns if c not in s])
        on = F.lit(True)
        for a, c in zip(s, names, strict=True):
            on = on & rows[c].eqNullSafe(e[f"{a}e"])
        return rows.join(small(e), on, "left").drop(*(f"{a}e" for a in s))

    for digits in range(DIGITS, 31, DIGITS):
        open_ = edge.where(F.col("_n").isNull() | (F.col("_n") > LEAF))
        if open_.isEmpty():
            break
        inside = joined(narrow, open_, s).where(F.col("_prefix").isNotNull() & F.startswith("_key", "_prefix"))
        counts = inside.groupBy(*s, "_need", F.substring("_key", 1, digits).alias("_prefix")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*s).orderBy("_prefix")  # 16 ** DIGITS rows at most
        counts = counts.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        # the bucket with the row that is wanted last; without one, all rows are wanted
        hit = counts.where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need")))
        hit = hit.select(*s, "_prefix", (F.col("_need") - F.col("_before")).alias("_need"), "_n")
        none = open_.join(hit.select(*(F.col(a).alias(f"{a}h") for a in s)), [F.col(a).eqNullSafe(F.col(f"{a}h")) for a in s], "left_anti") if s else open_.join(hit.limit(1).select(F.lit(1).alias("h")), how="left_anti")
        none = none.select(*s, F.when(F.col("_need") > 0, "g").otherwise("").alias("_prefix"), F.lit(0).cast("long").alias("_need"), F.lit(0).cast("long").alias("_n"))
        edge = shared.save(edge.where(F.col("_n") <= LEAF).unionByName(hit).unionByName(none), "edge")
    rows = joined(df.withColumn("_key", key), edge, strata)
    start = F.expr("left(_key, length(_prefix))")
    at = (F.col("_prefix") != "") & (start == F.col("_prefix"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_key", *ids))
    # only the bucket of the last row that is wanted is ranked
    ranked = rows.where(at).withColumn(name, rank <= F.col("_need"))
    others = rows.where(F.coalesce(~at, F.lit(True))).withColumn(name, F.coalesce((F.col("_prefix") != "") & (start < F.col("_prefix")), F.lit(False)))
    return ranked.unionByName(others).drop("_key", "_prefix", "_need", "_n")
