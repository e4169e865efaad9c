"""Counters, percentiles, roll-ups and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(c: Column) -> Column:
    return F.avg(c.cast("double"))


def count_reasons(df: DataFrame, reason: str) -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("rows"))


def count_flags(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(flags)).alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


def percentiles(df: DataFrame, value: str, qs: list[float], by: list[str], how: str = "floor", more: bool = False) -> DataFrame:
    """Values at index ``int((n - 1) q)`` (floor) or ``round((n - 1) q)`` with halves to even (round); with
    ``more`` also the mean and the median (the mean of the middle two).

    Equal values are counted first, map-side, and the places come from running sums of the counts: a group
    costs its distinct values, not its rows."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*by)
    run = counts.withColumn("_end", F.sum("_c").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(part))
    place = lambda q: (F.floor if how == "floor" else lambda c: F.bround(c, 0))((F.col("_n") - 1) * F.lit(q))
    holds = lambda at: (F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at)
    at = lambda i: F.max(F.when(holds(i), F.col(value)))
    out = [at(place(q)).alias(f"p{round(q * 100)}") for q in qs]
    if more:
        out += [(F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), ((at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2).alias("median")]
    return run.groupBy(*by).agg(*out)


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, exact median and maximum of a column per group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), value)


def top(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; ties by the value."""
    return df.groupBy(value).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), value).limit(k)


def passes(df: DataFrame, keys: list[str], ks: list[int], *, mode: str = "generation_mode", index: str = "candidate_index", correct: str = "answer_correct") -> DataFrame:
    """Per record the greedy score, the first sample's and pass@k over the first k samples (all, if there are
    fewer) in order of ``index``, whatever its values; null without samples. The aggregation keeps one
    boolean a sample."""
    sampled = F.col(mode) == "sampled"
    ordered = F.array_sort(F.collect_list(F.when(sampled, F.struct(F.col(index).alias("i"), (F.col(correct) > 0).alias("ok")))))
    grouped = df.groupBy(*keys).agg(F.max(F.when(F.col(mode) == "greedy", F.col(correct))).alias("pass1_greedy"), F.transform(ordered, lambda x: x["ok"]).alias("_ok"))
    any_of = lambda k: F.when(F.size("_ok") > 0, F.exists(F.slice("_ok", 1, k), lambda x: x).cast("double"))
    return grouped.select(*keys, "pass1_greedy", any_of(1).alias("pass1_sampled"), *(any_of(k).alias(f"pass{k}") for k in ks if k != 1))


def roll_up(df: DataFrame, metrics: list[str], *, model: str = "model", task: str = "task", bucket: str = "bucket") -> DataFrame:
    """Means (nulls skipped, 6 decimals) by task, by bucket and over all examples of a model."""
    by = df.groupingSets([[F.col(model), F.col(task)], [F.col(model), F.col(bucket)], [F.col(model)]], F.col(model), F.col(task), F.col(bucket))
    name = F.coalesce(F.col(task), F.concat(F.lit("bucket_"), F.col(bucket)), F.lit("macro_average")).alias("name")
    out = by.agg(F.count("*").alias("num_examples"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))
    return out.select(model, name, "num_examples", *metrics)


def mean_of(*cs: Column) -> Column:
    """The mean of those that aren't null."""
    a = F.array_compact(F.array(*cs))
    return F.when(F.size(a) > 0, F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), 6))


def group_statistics(df: DataFrame, keys: list[str], reward: str, correct: str) -> DataFrame:
    """Mean and population deviation of rewards in a group, and what kind of group it is."""
    r, c = F.col(reward), F.col(correct).cast("int")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(r).alias("reward_mean"), F.stddev_pop(r).alias("reward_std"), F.sum(c).alias("n_correct"), F.count_distinct(r).alias("rewards")
    )
    some = (F.col("n_correct") > 0) & (F.col("n_correct") < F.col("n"))
    return out.select(
        "*", (F.col("reward_std") <= 1e-8).alias("zero_std"), (F.col("n_correct") == F.col("n")).alias("all_correct"), (F.col("n_correct") == 0).alias("all_wrong"), (some & (F.col("rewards") > 1)).alias("mixed_reward")
    )


def entropy(df: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """Entropy in bits of a value's distribution per group, its distinct values and the share of the top k."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("c"), value)))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("kinds"), F.sum(F.when(F.col("place") <= k, F.col("p"))).alias("top_share"))


def funnel(df: DataFrame, steps: dict[str, Column], sample: str | None = None) -> DataFrame:
    """(at, step, input, filtered, remaining, examples): each row falls at the first step it fails."""
    names = list(steps)
    fell = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(steps.values())), F.lit(len(names)))
    examples = F.slice(F.array_sort(F.collect_list(F.when(F.col("_place") <= 5, F.col(sample).cast("string")))), 1, 5) if sample else F.array().cast("array<string>")
    rows = df.withColumn("_fell", fell)
    if sample:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_fell").orderBy(sample)))
    at = rows.groupBy("_fell").agg(F.count("*").alias("filtered"), examples.alias("examples"))
    spark = df.sparkSession
    every = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "_fell int, step string").join(at, "_fell", "left")
    total = at.agg(F.sum("filtered").alias("total"))
    gone = F.coalesce("filtered", F.lit(0))
    before = F.coalesce(F.sum(gone).over(Window.orderBy("_fell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a step
    out = every.join(F.broadcast(total)).withColumn("input", F.col("total") - before)
    return out.select(F.col("_fell").alias("at"), "step", "input", gone.alias("filtered"), (F.col("input") - gone).alias("remaining"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def step_windows(df: DataFrame, step: str, metrics: list[str], width: int = 10) -> DataFrame:
    """Means over all steps and over windows of ``width`` steps from 1."""
    low = (F.floor((F.col(step) - 1) / width) * width + 1).cast("long")
    name = F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))
    out = df.withColumn("window", name).rollup("window").agg(F.count("*").alias("rows"), *(F.avg(m).alias(m) for m in metrics))
    return out.withColumn("window", F.coalesce("window", F.lit("overall")))


def placed(df: DataFrame, bucket: str, order: str, size: int) -> DataFrame:
    """(bucket, order, bundle): prompts of each bucket in whole bundles of ``size``, in order."""
    w = Window.partitionBy(bucket)
    prompts = df.select(bucket, order).distinct().withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return prompts.withColumn("bundle", F.floor(F.col("_at") / size)).where((F.col("bundle") + 1) * size <= F.col("_n")).drop("_at", "_n")


def bundles(df: DataFrame, bucket: str, order: str, generation: str, reward: str, size: int) -> DataFrame:
    """(bucket, bundle, generation, total) over whole bundles of ``size`` prompts, in order."""
    return df.join(placed(df, bucket, order, size), [bucket, order]).groupBy(bucket, "bundle", generation).agg(F.sum(reward).alias("total"))


def bundle_spread(totals: DataFrame, by: list[str], size: int, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Over the sums of bundles: mean, deviation, two linear quantiles, the mean of the tail up to the lower
    one, and the shares of sums with nothing and with everything right."""
    q = totals.withColumn("_q", F.percentile("total", F.lit(low)).over(Window.partitionBy(*by)))
    t = F.col("total")
    return q.groupBy(*by).agg(
        F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.max("_q").alias("q_low"), F.percentile(t, F.lit(high)).alias("q_high"), F.avg(F.when(t <= F.col("_q"), t)).alias("tail_mean"),
        F.avg((t <= 0).cast("double")).alias("all_wrong_rate"), F.avg((t >= size).cast("double")).alias("all_correct_rate"), (F.avg(t) / size).alias("exact_rate"),
    )


def errors(df: DataFrame, pred: str, gold: str) -> DataFrame:
    d = F.col(pred) - F.col(gold)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n"))


def perplexity(loss: Column, tokens: Column) -> Column:
    return F.exp(F.sum(loss) / F.sum(tokens))


def metric_means(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Means by name, null and NaN left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(name).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def distribution(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, rows) of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims))
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("rows"))


def _ratio(cond: Column) -> Column:
    """The share of rows where a condition holds; 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(cond, F.lit(False)).cast("double")), F.lit(0.0))


def regroup(df: DataFrame, keys: list[str], *, mode: str = "generation_mode", index: str = "candidate_index") -> DataFrame:
    """(keys, greedy, samples): per record the greedy prediction, else the first of all, as a struct of the
    other columns, and the samples in order of ``index``."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    by = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(index).alias("i"), row.alias("row")))))
    g = df.groupBy(*keys).agg(F.min_by(row, F.struct((F.col(mode) != "greedy").alias("late"), index)).alias("greedy"), by(F.col(mode) == "sampled").alias("_s"))
    return g.select(*keys, "greedy", F.transform("_s", lambda x: x["row"]).alias("samples"))


def paired_summary(df: DataFrame, *, task: str, correct: str, flags: dict[str, Column], means: list[str]) -> DataFrame:
    """Per task and over all: examples, pass1, the share of each flag and means (nulls skipped); the row
    ``macro`` has the mean of the tasks' pass1."""
    out = [F.count("*").alias("num_examples"), F.avg(F.coalesce(F.col(correct).cast("double"), F.lit(0.0))).alias("pass1"), *(_ratio(c).alias(n) for n, c in flags.items()), *(F.avg(m).alias(m) for m in means)]
    by = df.rollup(task).agg(*out).withColumn(task, F.coalesce(task, F.lit("overall")))
    macro = by.where(F.col(task) != "overall").agg(F.lit("macro").alias(task), F.sum("num_examples").alias("num_examples"), F.avg("pass1").alias("pass1"))
    return by.unionByName(macro, allowMissingColumns=True)


# Fixed value: share of one program from which a record's candidates have collapsed.
COLLAPSED = 0.75


def candidate_metrics(df: DataFrame, keys: list[str], *, program: str, executable: str, correct: str, reward: str, completion: str | None = None, skeleton: str | None = None) -> DataFrame:
    """Per record over its candidates: shares of distinct completions, programs, programs that run and skeletons, the largest share of one program,
    counts of right, wrong and invalid candidates, deviation of rewards, and what kind of group it is.

    A null program is none: it counts as a candidate, but neither among the programs nor their shares. Without programs the largest share is 1.
    Without ``completion`` and ``skeleton`` a program stands for either."""
    has = F.col(program).isNotNull()
    runs, right = (F.coalesce(F.col(c), F.lit(False)) for c in (executable, correct))
    text = F.coalesce(F.col(completion), F.lit("")) if completion else F.coalesce(F.col(program), F.lit(""))
    per = df.groupBy(*keys, program).agg(F.count("*").alias("c"), F.count_if(runs).alias("e"))
    share = per.where(has).groupBy(*keys).agg(
        F.count("*").alias("_programs"), F.sum("c").alias("_with"), F.max("c").alias("_most"), F.count_if(F.col("e") > 0).alias("_ran"), F.sum("e").alias("_runs"),
    )
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(text).alias("_texts"), F.count_distinct(F.when(has, F.col(skeleton or program))).alias("_skeletons"), F.count_distinct(reward).alias("reward_unique_count"), F.stddev_pop(reward).alias("reward_std"),
        F.count_if(right).alias("correct_count"), F.count_if(runs & ~right).alias("wrong_executable_count"), F.count_if(~runs).alias("invalid_count"),
    )
    shares = share.select(*(F.col(k).alias(f"_{k}") for k in keys), "_programs", "_with", "_most", "_ran", "_runs")
    g = g.join(shares, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select(
        *keys, "n", (F.col("_texts") / F.col("n")).alias("exact_completion_unique_ratio"), (c("_programs") / F.col("n")).alias("unique_program_ratio"), ratio(c("_ran"), c("_runs")).alias("executable_program_unique_ratio"),
        (F.col("_skeletons") / F.col("n")).alias("skeleton_unique_ratio"), F.coalesce(F.try_divide(F.col("_most"), F.col("_with")), F.lit(1.0)).alias("max_program_share"), "reward_unique_count", "reward_std",
        "correct_count", "wrong_executable_count", "invalid_count", (F.col("reward_unique_count") >= 2).alias("mixed_reward"), ((F.col("correct_count") > 0) & (F.col("correct_count") < F.col("n"))).alias("answer_variance"),
        ((F.col("correct_count") > 0) & (F.col("wrong_executable_count") > 0)).alias("executable_contrast"), (c("_ran") >= 2).alias("effective_diversity"), (F.col("_skeletons") >= 2).alias("canonical_diversity"),
    ).withColumn("duplicate_collapse", F.col("max_program_share") >= COLLAPSED)


def diversity_summary(records: DataFrame, skeletons: DataFrame, skeleton: str, lookup: Column) -> DataFrame:
    """One row on all records: means and shares of ``candidate_metrics`` and of the gold programs' skeletons."""
    ratios = ("unique_program_ratio", "executable_program_unique_ratio", "max_program_share", "reward_std")
    flags = ("executable_contrast", "mixed_reward", "duplicate_collapse")
    a = records.agg(F.count("*").alias("records"), *(F.avg(c).alias(f"mean_{c}") for c in ratios), *(_ratio(F.col(c)).alias(f"{c}_ratio") for c in flags))
    e = entropy(skeletons.withColumn("_all", F.lit(1)), ["_all"], skeleton, 1).select(F.col("entropy").alias("skeleton_entropy"), F.col("kinds").alias("skeletons"), F.col("top_share").alias("top1_skeleton_share"))
    look = skeletons.agg(_ratio(lookup).alias("direct_lookup_share"))
    return a.join(F.broadcast(e)).join(F.broadcast(look))  # one row each


def probe_summary(groups: DataFrame) -> DataFrame:
    """One row over group statistics (n, n_correct, n_executable, n_programs, n_distinct, zero_std, all_correct,
    all_wrong, mixed_reward, history): counts and shares, 0 where there is nothing to divide by."""
    share = lambda a, b: (F.sum(a) / F.greatest(F.sum(b), F.lit(1))).alias
    kinds = ("zero_std", "all_correct", "all_wrong", "mixed_reward")
    return groups.agg(
        F.count("*").alias("records"), F.sum("n").alias("total_completions"), *(_ratio(F.col(k)).alias(f"{k}_ratio") for k in kinds),
        share("n_correct", "n")("sampled_correct_rate"), share("n_executable", "n")("sampled_executable_rate"), share("n_distinct", "n_programs")("unique_program_ratio"),
        F.count_if("history").alias("history_records"), F.count_if(~F.col("history")).alias("nonhistory_records"),
    )


def frontier_summary(df: DataFrame, *, label: str, phase: str, keys: dict[str, Column]) -> DataFrame:
    """Per label, and over all (``overall``): rows, their share, distinct values of each key and rows by phase."""
    counts = [F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"unique_{n}") for n, c in keys.items()), *(F.count_if(F.col(phase) == p).alias(p) for p in ("pilot", "extension"))]
    by = df.rollup(label).agg(*counts).withColumn(label, F.coalesce(label, F.lit("overall")))
    total = F.max(F.when(F.col(label) == "overall", F.col("rows"))).over(Window.partitionBy())  # a row a label
    return by.withColumn("share", F.round(F.col("rows") / total, 6))


def run_summary(df: DataFrame, family: str, counters: dict[str, Column]) -> DataFrame:
    """(family, counters map<string, long>) in one pass; counters that are 0 stay."""
    names = list(counters)
    g = df.groupBy(family).agg(F.count("*").alias("_rows"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(counters.values())))
    entries = F.array(F.struct(F.lit("rows").alias("key"), F.col("_rows").alias("value")), *(F.struct(F.lit(n).alias("key"), F.col(f"_{i}").alias("value")) for i, n in enumerate(names)))
    return g.select(family, F.map_from_entries(entries).alias("counters"))


def rows_audit(df: DataFrame, *, prompt: str, problems: dict[str, Column]) -> DataFrame:
    """One row: rows, rows whose prompt came before, and rows with each problem. Prompts are counted by hash."""
    by = df.groupBy(F.md5(prompt).alias("_p")).agg(F.count("*").alias("_n"), *(F.count_if(c).alias(n) for n, c in problems.items()))
    return by.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_prompt_rows"), *(F.sum(n).alias(n) for n in problems))
