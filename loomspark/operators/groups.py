"""Windows over ordered groups: history, best and worst of a group, risk shaping, early stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(turns: DataFrame, key: str, order: str, text: str, last: int = 3) -> DataFrame:
    """Each row with the texts of the ``last`` rows before it in its group."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1)
    return turns.withColumn("history", F.collect_list(text).over(w)).withColumn("history_turns", F.size("history"))


def best_and_worst(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """``chosen`` is the first row of the best score, ``rejected`` the first of the worst of the others."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_best", F.row_number().over(w.orderBy(F.desc(score), order)))
    ranked = ranked.withColumn("_worst", F.row_number().over(w.orderBy(F.expr("_best = 1"), score, order)))
    n = F.count("*").over(w)
    role = F.when(F.col("_best") == 1, "chosen").when((F.col("_worst") == 1) & (n > 1), "rejected")
    return ranked.withColumn("pick", role).drop("_best", "_worst")


def risk_shaped(df: DataFrame, keys: list[str], reward: str = "reward", *, q25_floor: float = 0.2, cap: float = 0.2, invalid: float = 0.25, wrong: float = 0.5, process_floor: float = 0.5,
                bonus: float = 0.0, single_clip: float = 0.0, penalty: float = 0.05, semantic: float = 0.1, skip_all_wrong: bool = True, invalid_floor: float = -1.0) -> DataFrame:
    """``df`` with ``risky`` and ``shaped``: rewards of risky groups adjusted by their members.

    df has exact, invalid and wrong_executable (booleans), process and strict (doubles). A group of two or
    more is risky by its reward's lower quartile, its shares of invalid and of wrong but executable members,
    its process scores' lower quartile, or any member that isn't strict. Then, without a right member, all get
    the mean (``skip_all_wrong``); right members get a bonus, a single one no more than ``single_clip`` above
    the best wrong; wrong ones a penalty, more for a poor process, not below their floor."""
    w = Window.partitionBy(*keys)
    r, exact = F.col(reward), F.col("exact")
    share = lambda c: F.avg(F.col(c).cast("double")).over(w)
    low = F.percentile(reward, F.lit(0.25)).over(w)
    facts = df.withColumn("_n", F.count("*").over(w)).withColumn("_low", low).withColumn("_mean", F.avg(r).over(w)).withColumn("_right", F.count_if(exact).over(w)).withColumn("_best", F.max(F.when(~exact, r)).over(w))
    facts = facts.withColumn("_proc", F.percentile("process", F.lit(0.25)).over(w)).withColumn("_strict", F.min("strict").over(w))
    bad = (F.col("_low") < q25_floor) | (F.col("_low") <= cap) | (share("invalid") > invalid) | (share("wrong_executable") >= wrong) | (F.col("_proc") < process_floor) | (F.col("_strict") < 1.0)
    facts = facts.withColumn("risky", (F.col("_n") > 1) & F.coalesce(bad, F.lit(False)))
    up = r + F.lit(max(bonus, 0.0))
    if single_clip > 0:
        up = F.when((F.col("_right") == 1) & F.col("_best").isNotNull(), F.least(up, F.col("_best") + F.lit(single_clip))).otherwise(up)
    cost = F.lit(penalty) + F.when(F.col("wrong_executable"), F.lit(semantic) * F.greatest(F.lit(0.0), 1.0 - F.col("process"))).otherwise(0.0)
    down = F.greatest(F.when(F.col("invalid"), invalid_floor).otherwise(0.0), r - cost)
    moved = F.when((F.col("_right") == 0) & F.lit(skip_all_wrong), F.col("_mean")).when(exact, up).otherwise(down)
    return facts.withColumn("shaped", F.when(F.col("risky"), moved).otherwise(r)).drop("_n", "_low", "_mean", "_right", "_best", "_proc", "_strict")


# What the rules of an early stop look at and when they apply.
NO_SPREAD, ZERO_SHARE, LEAST_RUNS = 1e-8, 0.8, 0.7
VARIANCE, CONTRACT, UNSTABLE = "zero_reward_variance", "execution_contract_regression", "numerical_instability"


def early_stop(df: DataFrame, key: str, step: str, finite: Sequence[str] = ("loss",)) -> DataFrame:
    """``df`` with ``stop``: the reason to stop after each row of a trace, null if there is none.

    df has reward_std, zero_std (boolean), executable_rate, marker_rate, multiple_program_rate, all_wrong
    (boolean) and the columns of ``finite``, all that is logged as a number. Rules look at the last 3, 5 or 10 rows, markers at all so far; the last rule that
    applies names the reason, in this order: no spread in 5 rows; else no spread in 8 of 10; else less than
    0.7 executable over 10; any marker; several programs in 3 rows; 5 rows all wrong; a logged number that isn't finite."""
    tail = lambda n: Window.partitionBy(key).orderBy(step).rowsBetween(-(n - 1), 0)
    full = lambda n: F.count("*").over(tail(n)) == n
    share = lambda c, n: F.avg(F.coalesce(c, F.lit(False)).cast("double")).over(tail(n))
    all_of = lambda c, n: full(n) & (share(c, n) == 1.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    spread = F.when(all_of(number("reward_std") <= NO_SPREAD, 5) | (full(10) & (share(F.col("zero_std"), 10) >= ZERO_SHARE)), VARIANCE)
    runs = F.when(full(10) & (F.avg(number("executable_rate")).over(tail(10)) < LEAST_RUNS), CONTRACT)
    so_far = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    rules = [
        F.coalesce(spread, runs),
        F.when(F.max(number("marker_rate")).over(so_far) > 0, CONTRACT),
        F.when(all_of(number("multiple_program_rate") > 0, 3), CONTRACT),
        F.when(all_of(F.col("all_wrong"), 5), VARIANCE),
        F.when(F.coalesce(F.exists(F.array(*(F.col(c).cast("double") for c in finite)), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)), UNSTABLE),
    ]
    return df.withColumn("stop", F.coalesce(*reversed(rules)))


def bundle_advantages(df: DataFrame, bucket: str, order: str, generation: str, reward: str, size: int, *, low: float = 0.2, high: float = 0.8, tail: float = 1.0, normalize: bool = True) -> DataFrame:
    """``df`` with ``advantage`` of each row by its bundle: rewards are summed over the prompts of a bundle for
    each generation, and a sum counts by where it lies between two quantiles of its bundle and by how far it
    is below the lower one. Null for rows of partial bundles and of bundles without spread, which keep what
    they have."""
    from .aggregates import bundles, placed

    eps = 1e-6
    w = Window.partitionBy(bucket, "bundle")
    t = bundles(df, bucket, order, generation, reward, size)
    t = t.withColumn("_std", F.stddev_pop("total").over(w)).withColumn("_lo", F.percentile("total", F.lit(low)).over(w)).withColumn("_hi", F.percentile("total", F.lit(high)).over(w))
    over = lambda c: F.greatest(F.col("total") - F.col(c), F.lit(0.0))
    inner = (over("_lo") - over("_hi") + F.col("_lo") - F.col("_hi")) / F.lit(high - low + eps)
    below = -F.greatest(F.col("_lo") - F.col("total"), F.lit(0.0)) / F.lit(low + eps)
    value = (F.lit(tail) * below + inner) / F.lit(tail + 1.0)
    value = value / (F.col("_std") + F.lit(eps)) if normalize else value
    t = t.select(bucket, "bundle", generation, F.when(F.col("_std") > eps, value).alias("advantage"))
    return df.join(placed(df, bucket, order, size), [bucket, order], "left").join(t, [bucket, "bundle", generation], "left")


def first_and_rest(scores: Column, good) -> tuple[Column, Column]:
    """The first element that satisfies ``good`` and its index from 0."""
    hit = F.filter(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: good(x["s"]))
    first = F.try_element_at(hit, F.lit(1))
    return first["s"], first["i"]
