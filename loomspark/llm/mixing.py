"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every row has a hash of 60 bits from its id and text. A source takes every row ``full`` times and
the rows whose hash is at most the source's threshold once more. The threshold comes from a
histogram of sizes by source and the hash's first 12 bits: the bucket in which the running sum
crosses the budget is refined by the next 12 bits, over its own rows only, down to one hash. Nothing
is sorted but the buckets of a source (4096 at most) and the sources.

Defined cases: a null text or one without words has size 0 and is neutral to the targets. A null
source is a source of its own, ranked last. Rows equal in id and text have the same hash and are
taken alike. Columns beyond id, source and text don't matter, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``weights`` repeat over the sources in code-point order. With s the sizes and w the weights, the
    target is ``least(most * s, level * w)``: raising the level until the targets sum to the budget
    is what resharing the excess by weight comes to. The windows hold one row per source.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n") - 1) % len(weights) + 1)
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    total = F.lit(float(budget)) * F.sum("source_size").over(every)
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left("w"))
    return ranked.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("w")).alias("target"))


def thresholds(narrow: DataFrame, scratch: Scratch, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target, full, threshold) from (source, size, hash)."""
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    goals = goals.withColumn("full", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    goals = scratch.save(goals.withColumn("need", F.col("target") - F.col("full") * F.col("source_size")), "goals")
    # source, need, the boundary bucket's prefix and the size before it
    edge = goals.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    rows = narrow.where("size > 0")
    for done in range(0, BITS, STEP):
        key = F.shiftright("hash", BITS - done) if done else F.lit(0).cast("long")
        e = edge.withColumnRenamed("source", "of")
        inside = rows.join(e, rows["source"].eqNullSafe(e["of"]) & (key == e["prefix"])).select("source", "size", "hash", "need", "before")
        bucket = F.shiftright("hash", BITS - done - STEP)
        counted = inside.groupBy("source", "need", "before", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
        crossing = counted.withColumn("upto", upto).where("upto - s < need and upto >= need")
        edge = scratch.save(crossing.select("source", "need", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("s")).alias("before"), "s"), "edge")
        if not done:  # a 4096th of the rows is left
            e = edge.select(F.col("source").alias("of"), "prefix")
            rows = scratch.save(rows.join(e, rows["source"].eqNullSafe(e["of"]) & (F.shiftright("hash", BITS - STEP) == e["prefix"]), "left_semi"), "boundary")
        edge = edge.drop("s") if done + STEP < BITS else edge
    # the last bucket is one hash: in if that comes nearer to the budget
    cut = F.col("prefix") - F.when(2 * (F.col("need") - F.col("before")) >= F.col("s"), 0).otherwise(1)
    edge = edge.select(F.col("source").alias("of"), cut.alias("threshold"))
    out = goals.join(edge, goals["source"].eqNullSafe(edge["of"]), "left")
    return scratch.save(out.select("source", "source_size", "target", "full", F.coalesce("threshold", F.lit(-1)).cast("long").alias("threshold")), "thresholds")


def _copies(hash_: Column, full: Column, threshold: Column) -> Column:
    return full + F.when(hash_ <= threshold, 1).otherwise(0)


def mix_sizes(docs: DataFrame, *, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, copies (how often the mix takes it)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), row_hash(id_col, text_col).alias("hash"))
    narrow = scratch.save(narrow, "sizes")
    t = thresholds(narrow, scratch, tuple(weights), budget, most).withColumnRenamed("source", "of")
    out = narrow.join(t, narrow["source"].eqNullSafe(t["of"]))
    return out.select("id", "size", "source_size", "target", _copies(F.col("hash"), F.col("full"), F.col("threshold")).alias("copies"))


def mix(docs: DataFrame, *, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.save(docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"), row_hash(id_col, text_col).alias("hash")), "sizes")
    t = thresholds(narrow, scratch, tuple(weights), budget, most)
    names = set(docs.columns)
    own = {c: next(x for x in (f"_{c}{'_' * k}" for k in range(len(names) + 1)) if x not in names) for c in ("source", "full", "threshold", "copy")}
    t = t.select(*(F.col(c).alias(own[c]) for c in ("source", "full", "threshold")))
    out = docs.join(t, docs[source_col].eqNullSafe(t[own["source"]]))
    copies = _copies(row_hash(id_col, text_col), F.col(own["full"]), F.col(own["threshold"])).cast("int")
    return out.withColumn(own["copy"], F.explode(F.array_repeat(F.lit(1), copies))).select(*(docs[c] for c in docs.columns))
