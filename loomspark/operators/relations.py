"""Joins, conflict detection, dedupe and set operations keyed by record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.shared import Shared
from .offsets import running

#: Tokens of an overlap n-gram, in lower case: words or single other characters. The ASCII part of the class
#: is looked up first, the rest of the word characters only where it fails.
TOKEN = r"(?U)([a-z0-9_\w]++|[^\w\s])"


def first_of_key(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if last else F.asc(c) for c in order])
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with ``missing``; Spark picks broadcast or shuffle by size."""
    return left.join(right.withColumn("_hit", F.lit(True)), keys, "left").withColumn("missing", F.col("_hit").isNull()).drop("_hit")


def allow(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def exclude(df: DataFrame, *ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in none of the others; rows without a key stay."""
    for other in ids:
        df = df.join(other.select(*keys).distinct(), keys, "left_anti")
    return df


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)


def _grams(tokens: Column, n: int, of) -> Column:
    """``of`` each run of n tokens. The tokens are bound once, so that a text is cut once and not for every n-gram."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: of(F.slice(t, i, n)))
    return bind(tokens, lambda t: F.when(F.size(t) >= n, grams(t)))


def ngrams(text: Column, n: int) -> Column:
    return F.coalesce(_grams(_tokens(text), n, lambda g: F.array_join(g, " ")), F.array().cast("array<string>"))


def ngram_hashes(text: Column, n: int) -> Column:
    """64-bit hashes of the n-grams, made of the tokens' hashes; null with fewer tokens than n."""
    return _grams(F.transform(_tokens(text), lambda w: F.xxhash64(w)), n, lambda g: F.xxhash64(g))


def overlaps(rows: DataFrame, reference: DataFrame, n: int = 8, text: str = "text") -> DataFrame:
    """Rows that share an n-gram with the reference, with the number of distinct shared ones.

    Only hashes are exploded and joined. Of m distinct n-grams in the reference, one in 2 ** 64 / m other
    n-grams is taken for one of them."""
    ref = reference.select(F.explode(ngram_hashes(F.col(text), n)).alias("h")).distinct()
    keep = [c for c in rows.columns if c != text]
    grams = rows.select(*keep, F.explode(ngram_hashes(F.col(text), n)).alias("h"))
    # only shared n-grams are counted, so repeats within a text go after the join
    return grams.join(ref, "h", "left_semi").distinct().groupBy(*keep).agg(F.count("*").alias("shared"))


def conflicts(df: DataFrame, prompt: str, label: str) -> DataFrame:
    """``df`` with group_size and labels (distinct ones) of its prompt; prompts are grouped by hash."""
    key = F.md5(F.col(prompt))
    by = df.groupBy(key.alias("_k")).agg(F.count("*").alias("group_size"), F.count_distinct(label).alias("labels"))
    return df.withColumn("_k", key).join(by, "_k", "left").drop("_k")


def keep_first_label(df: DataFrame, prompt: str, label: str, order: str) -> DataFrame:
    """Rows whose label is the first one seen for their prompt."""
    w = Window.partitionBy(prompt).orderBy(order)
    return df.withColumn("_first", F.first(label).over(w)).where(F.col("_first").eqNullSafe(F.col(label))).drop("_first")


def prior_turn(turns: DataFrame, key: str, order: str, question: str) -> DataFrame:
    """Each turn with the order of the latest earlier turn that asks the same."""
    w = Window.partitionBy(key, question).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("prior", F.max(order).over(w))


def paired(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """(key, old, new, change) of two models' scores on the same records."""
    both = a.select(key, F.col(score).alias("old")).join(b.select(key, F.col(score).alias("new")), key)
    change = F.when((F.col("old") == 0) & (F.col("new") > 0), "new_correct").when((F.col("old") > 0) & (F.col("new") == 0), "new_wrong").otherwise("same")
    return both.withColumn("change", change)


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, value) tables side by side, with whether they match, null values included."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.withColumn("match", F.col("left").eqNullSafe(F.col("right")))


def candidates(df: DataFrame, k: int, temperatures: list[float]) -> DataFrame:
    """Every record k times, with candidate_index and a temperature taken in turn."""
    out = df.withColumn("candidate_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    temps = F.array(*(F.lit(t) for t in temperatures))
    return out.withColumn("temperature", F.element_at(temps, F.col("candidate_index") % len(temperatures) + 1))


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done, keys, "left_anti")


def trace_with_log(trace: DataFrame, log: DataFrame, step: str = "step", order: str = "ord") -> DataFrame:
    """The trace with the log's fields; later entries of a step go over earlier ones, field by field."""
    fields = [c for c in log.columns if c not in (step, order)]
    merged = log.groupBy(step).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))
    return trace.join(merged, step, "left")


def pair_positives(positive: Column, negative: Column, most: int) -> Column:
    """array<struct<chosen, rejected>>: each positive with the first negative that differs, at most ``most``."""
    made = F.transform(positive, lambda p: F.struct(p.alias("chosen"), F.try_element_at(F.filter(negative, lambda n: n != p), F.lit(1)).alias("rejected")))
    return F.slice(F.filter(made, lambda x: x["rejected"].isNotNull()), 1, most)


#: Rows of a component of keys and prompts up to which one task may pass over it in order.
ONE_TASK = 1_000_000


def sequential_dedupe(df: DataFrame, key: str, prompt: str, order: str, one_task: int = ONE_TASK) -> DataFrame:
    """Rows of which no kept row before (by ``order``, unique) has the key or the prompt. Nulls are equal to one another.

    Of the open rows, those that come first of their key and of their prompt stay. A row with one open row before it, in its key or its prompt, stays
    if that one goes: such rows hang on one another in chains, which doubling resolves in a logarithmic number of joins, however long they are. Rows that
    share a key or a prompt with one that stays go. Where a round decides less than half of the open rows, each connected component of keys and prompts that
    has up to ``one_task`` rows is passed over in order by one task; greater ones go on in rounds, each of which decides some rows.
    No window holds more than two rows of a key from each task. Actions run while the plan is built; steps are written to the shared folder."""
    shared = Shared(df.sparkSession, "sequential-dedupe")
    text = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value"))
    rows = df.select(F.col(order).alias("at"), F.xxhash64(F.lit(1), text(key)).alias("k1"), F.xxhash64(F.lit(2), text(key)).alias("k2"), F.xxhash64(F.lit(1), text(prompt)).alias("p1"), F.xxhash64(F.lit(2), text(prompt)).alias("p2"))
    rows = rows.select("at", F.struct("k1", "k2").alias("k"), F.struct("p1", "p2").alias("p"))
    # of equal pairs only the first can stay
    open_ = shared.save(rows.groupBy("k", "p").agg(F.min("at").alias("at")), "open")
    left, kept = open_.count(), []
    while left:
        first = shared.save(_first_in_both(open_), "first")
        stay = shared.save(_alternating(first, shared), "stay")
        kept.append(stay.select("at"))
        rest = open_.join(stay.select("k").distinct(), "k", "left_anti").join(stay.select("p").distinct(), "p", "left_anti")
        open_ = shared.save(rest, "open")
        before, left = left, open_.count()
        if left > before / 2:
            root = _components(open_, shared)
            small = root.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= one_task).select("root")
            root = shared.save(root.join(small.withColumn("small", F.lit(True)), "root", "left"), "root")
            passed = root.where("small").select("root", "at", "k", "p").groupBy("root").applyInPandas(_pass, "at " + df.schema[order].dataType.simpleString())
            kept.append(shared.save(passed, "passed"))
            open_ = shared.save(root.where("small is null").select("k", "p", "at"), "open")
            left = open_.count()
    if not kept:
        return df.where(F.lit(False))
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    return df.join(every.withColumnRenamed("at", order), order, "left_semi")


def _first_in_both(open_: DataFrame) -> DataFrame:
    """Open rows with ``before``: null for those first of key and prompt; the one open row before those that have one; rows with more are left out."""

    def two(c: str) -> DataFrame:
        w = Window.partitionBy(c).orderBy("at")
        return open_.select(c, "at", F.row_number().over(w).alias("n")).where("n <= 2")

    def place(c: str) -> DataFrame:
        t = two(c)
        lead = t.where("n = 1").select(c, F.col("at").alias("lead"))
        return t.join(lead, c).select("at", F.col("n").alias(f"n_{c}"), F.when(F.col("n") == 2, F.col("lead")).alias(f"lead_{c}"))

    both = open_.join(place("k"), "at").join(place("p"), "at").where("n_k = 1 or n_p = 1")
    return both.select("at", "k", "p", F.coalesce("lead_k", "lead_p").alias("before"))


def _alternating(first: DataFrame, shared: Shared) -> DataFrame:
    """The rows that stay among chains of rows with one row before: those an even number of steps from a first one."""
    t = shared.save(first.select("at", F.coalesce("before", "at").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("odd"), F.col("before").isNull().alias("done")), "chain")
    while True:
        up = t.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"), F.col("done").alias("ends"))
        # a row whose chain leads to one with several rows before it waits
        joined = t.where("not done").join(up, "to").select("at", F.col("next").alias("to"), (F.col("odd") + F.col("more")) % 2, "ends")
        moved = shared.save(joined.toDF("at", "to", "odd", "done"), "moved")
        if moved.isEmpty():
            break
        t = shared.save(t.where("done").unionByName(moved), "chain")
    return first.join(t.where("done and odd = 0").select("at"), "at")


def _components(open_: DataFrame, shared: Shared) -> DataFrame:
    """Open rows with ``root``, the least row of those that shared keys and prompts connect: the least root of a key and of a prompt, and of the root itself, in turns."""
    t = shared.save(open_.withColumn("root", F.col("at")), "labels")
    while True:
        least = lambda d, c: d.join(d.groupBy(c).agg(F.min("root").alias("least")), c).withColumn("root", F.col("least")).drop("least")
        n = least(least(t.withColumn("was", F.col("root")), "k"), "p")
        up = n.groupBy(F.col("was").alias("root")).agg(F.min("root").alias("next"))  # the least that any row of an old root found
        n = n.join(up.withColumnRenamed("root", "was"), "was").select("k", "p", "at", F.least("root", "next").alias("root"), "was")
        n = shared.save(n, "labels")
        done = n.where("root <> was").isEmpty()
        t = n.drop("was")
        if done:
            return t


def _pass(rows: pd.DataFrame) -> pd.DataFrame:
    keys, prompts, kept = set(), set(), []
    for at, k, p in rows.sort_values("at")[["at", "k", "p"]].itertuples(index=False):
        k, p = tuple(k.values()) if isinstance(k, dict) else tuple(k), tuple(p.values()) if isinstance(p, dict) else tuple(p)
        if k not in keys and p not in prompts:
            keys.add(k)
            prompts.add(p)
            kept.append(at)
    return pd.DataFrame({"at": kept})


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables side by side by their place in order, from 1, up to the end of the shorter."""
    return places(left, left_order, "place").join(places(right, right_order, "place"), "place")


def places(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row by ``order`` (unique), from 1. Places come from running sums over ranges of
    the order alone, as many ranges as Spark makes of the table; no task holds a whole table. Actions run while the plan is built."""
    at = running(df, F.lit(0), order, F.lit(1), Shared(df.sparkSession, "places"))
    return df.join(at.select(order, (F.col("at") + 1).alias(name)), order)


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of either side and of both."""
    side = lambda d, n: d.select(*keys).distinct().withColumn(n, F.lit(1))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    return both.agg(F.count("a").alias("left_ids"), F.count("b").alias("right_ids"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_ids"))


def new_pieces(vocabulary: DataFrame, more: DataFrame, column: str = "piece") -> DataFrame:
    """The vocabulary and the pieces of ``more`` that it lacks."""
    return vocabulary.select(column).unionByName(more.select(column).distinct().join(vocabulary, column, "left_anti"))
