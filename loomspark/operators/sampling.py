"""Deterministic sampling, splits and mixes. Random order is that of ``md5(seed:id)``, the same in any
partitioning and in other engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Shared
from .offsets import mark_lowest, running, small


def order_key(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in ids)))


def take(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows in random order; fewer if there are no more."""
    return df.orderBy(order_key(seed, *(F.col(c) for c in ids)), *ids).limit(n)


def take_in_order(df: DataFrame, n: int, seed: int, order: str, *ids: str) -> DataFrame:
    """n rows at random, sorted by ``order`` as they were."""
    return take(df, n, seed, *ids).orderBy(order)


def per_stratum(df: DataFrame, strata: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def quotas(counts: DataFrame, n: int, strata: list[str], count: str = "c") -> DataFrame:
    """Proportional quotas: whole parts, then one more by the largest remainders, never over a stratum's
    count. The windows hold one row per stratum."""
    every = Window.partitionBy()
    want = F.least(F.lit(n), F.sum(count).over(every))
    share = F.col(count) * want / F.sum(count).over(every)
    q = counts.withColumn("base", F.floor(share)).withColumn("rest", share - F.floor(share)).withColumn("want", want)
    left = F.col("want") - F.sum("base").over(every)
    q = q.withColumn("more", F.row_number().over(Window.orderBy(F.desc("rest"), *strata)) <= left)
    return q.select(*strata, count, (F.col("base") + F.col("more").cast("long")).alias("quota"))


def stratified(df: DataFrame, strata: list[str], n: int, seed: int, *ids: str) -> DataFrame:
    """n rows in proportion to the strata, at random within each. Histograms of the order find each stratum's last row; no task holds a stratum."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("c"))
    key = order_key(seed, *(F.col(c) for c in ids))
    return mark_lowest(df, strata, quotas(counts, n, strata), key, list(ids), "_in").where("_in").drop("_in")


def round_robin(df: DataFrame, strata: list[str], n: int, *order: Column) -> DataFrame:
    """One row of each stratum per pass until there are n."""
    w = Window.partitionBy(*strata).orderBy(*order)
    # no stratum gives more than n
    return df.withColumn("_pass", F.row_number().over(w)).where(F.col("_pass") <= n).orderBy("_pass", *strata, *order).limit(n).drop("_pass")


def priority_fill(df: DataFrame, priority: Column, n: int, seed: int, *ids: str) -> DataFrame:
    """One row of each priority class in order, then any at random, n in all. Each class's first row comes from an aggregate."""
    key = order_key(seed, *(F.col(c) for c in ids))
    at = F.struct(key.alias("key"), *ids)
    ranked = df.withColumn("_class", F.struct(priority.alias("v"))).withColumn("_at", at)
    first = small(ranked.groupBy("_class").agg(F.min("_at").alias("_least")))
    ranked = ranked.join(first, "_class").withColumn("_first", F.col("_at") == F.col("_least"))
    return ranked.orderBy(F.desc("_first"), F.when(F.col("_first"), F.col("_class.v")), "_at").limit(n).select(*df.columns)


def cycle(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows, all as often as any other but for one; the pool is shuffled anew each time."""
    size = max(1, df.count())
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // size))))
    return copies.orderBy("copy", order_key(seed, F.col("copy"), *(F.col(c) for c in ids)), *ids).limit(n)


def replay_count(main: int, ratio: float, available: int) -> int:
    """Rows to add so that they are ``ratio`` of the mix."""
    return min(available, round(main * ratio / max(1.0 - ratio, 1e-8))) if main and ratio > 0 else 0


def mix(parts: dict[str, tuple[DataFrame, float]], n: int, seed: int, *ids: str) -> DataFrame:
    """n rows of several sources by weight; a source gives what it has."""
    total = sum(w for _, w in parts.values())
    out = None
    for name, (df, weight) in parts.items():
        part = take(df, round(n * weight / total), seed, *ids).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split(df: DataFrame, valid: float, seed: int, *ids: str, least: int = 1, most: int | None = None) -> DataFrame:
    """``df`` with ``split``: about the share ``valid``, ``least`` at least, ``most`` at most, never all."""
    n = df.count()
    k = 0 if valid <= 0 or n <= 1 else min(n - 1, max(least, round(n * valid)), most if most is not None else n)
    chosen = df.select(*ids).orderBy(order_key(seed, *(F.col(c) for c in ids)), *ids).limit(k).withColumn("split", F.lit("valid"))
    return df.join(chosen, list(ids), "left").withColumn("split", F.coalesce("split", F.lit("train")))


def exact_or_raise(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows; fails if there are fewer."""
    have = df.count()
    if have < n:
        raise ValueError(f"needs {n} rows, has {have}")
    return df.orderBy(*order).limit(n)


def chunks(df: DataFrame, size: int, order: str, by: list[str]) -> DataFrame:
    """``df`` with ``part``: parts of ``size`` rows within each group, in order (unique in a group); places come from running sums over ranges."""
    shared = Shared(df.sparkSession, "chunks")
    at = running(df, F.struct(*by), order, F.lit(1), shared)
    key = F.struct(F.struct(*by).alias("v"))
    return df.withColumn("_g", key).join(at.select(F.col("g").alias("_g"), order, F.floor(F.col("at") / size).alias("part")), ["_g", order]).select(*df.columns, "part")


def phases(df: DataFrame, pilot: int, by: list[str], seed: int, *ids: str) -> DataFrame:
    """``df`` with ``phase``: the first ``pilot`` rows of each group, at random, are the pilot."""
    wanted = df.select(*by).distinct().withColumn("quota", F.lit(pilot))
    marked = mark_lowest(df, by, wanted, order_key(seed, *(F.col(c) for c in ids)), list(ids), "_in")
    return marked.withColumn("phase", F.when(F.col("_in"), "pilot").otherwise("extension")).drop("_in")


def bucket_mix(df: DataFrame, buckets: dict[str, tuple[Column, float]], n: int, seed: int, *ids: str, rest: str = "rest") -> DataFrame:
    """n rows of ``df`` with ``bucket``: each bucket gives its share, repeating its rows if it has too few;
    what no bucket holds gives the remainder. An empty bucket's share, and rows missing at the end, come from all."""
    wants = {name: (cond, round(n * share)) for name, (cond, share) in buckets.items()}
    wants[rest] = (~F.coalesce(F.greatest(*(c.cast("int") for c, _ in buckets.values())), F.lit(0)).cast("boolean"), max(0, n - sum(k for _, k in wants.values())))
    have = df.agg(*(F.count_if(c).alias(name) for name, (c, _) in wants.items())).first()
    out = None
    for name, (cond, k) in wants.items():
        if k:
            part = cycle(df.where(cond) if have[name] else df, k, seed, *ids).withColumn("bucket", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def budgets(sources: dict[str, tuple[int, int, int | None]], budget: int | None, most: int | None = None) -> dict[str, int]:
    """Rows to take of each source (target, available, its own cap): the budget shared by targets, never over
    ``most``, the cap or what there is. Without a budget a source's target counts."""
    total = sum(t for t, _, _ in sources.values())
    share = lambda t: t if budget is None else round(budget * t / total) if total else budget
    return {name: min(x for x in (share(t), have, cap, most) if x is not None) for name, (t, have, cap) in sources.items()}


def budgeted_mix(sources: dict[str, tuple[DataFrame, int, int | None]], budget: int, seed: int, *ids: str, most: int | None = None) -> DataFrame:
    """Rows of several sources (rows, target, cap) with ``part``, as many of each as ``budgets`` says."""
    takes = budgets({name: (t, df.count(), cap) for name, (df, t, cap) in sources.items()}, budget, most)
    out = None
    for name, (df, _, _) in sources.items():
        part = take(df, takes[name], seed, *ids).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
