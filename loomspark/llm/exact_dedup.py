"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

1. The SHA-256 digest of every text goes, with the id, to a narrow table.
2. A Misra-Gries summary (``freqItems``: one mergeable table of at most ``1 / support`` counters a
   task) names every digest that more than ``support`` of the rows share, perhaps with others.
3. An exact count over the named digests only, combined map-side, verifies them and finds the row
   of each that stays. There are at most ``1 / support`` winners, so they may be broadcast.
4. Rows with a winner's digest are settled map-side. The rest, whose groups each hold less than
   ``support`` of the rows, take one ordinary shuffle on the digest.

Defined cases: a null text counts as the empty text. Null ids rank below all others. Among rows that
are equal in text and id (repeated rows, null ids) exactly one stays. Columns beyond the id and the
text don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Share of all rows above which a digest is settled by broadcast; 1 / SUPPORT bounds what is broadcast.
SUPPORT = 1e-3


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _split(docs: DataFrame, scratch: Scratch, support: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The narrow table (id, digest, row) and the verified winners (digest, n, best, at)."""
    narrow = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
    narrow = scratch.save(narrow.withColumn("row", F.monotonically_increasing_id()), "digests")
    # freqItems tells binary values apart by reference, so it gets text
    frequent = narrow.select(F.hex("digest").alias("hex")).freqItems(["hex"], support).select(F.explode("hex_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    frequent = scratch.save(frequent.distinct(), "frequent")  # at most 1 / support rows
    counted = narrow.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("top"))
    winners = counted.where(F.col("n") > narrow.count() * support)
    return narrow, scratch.save(winners.select("digest", "n", F.col("top.id").alias("best"), F.col("top.row").alias("at")), "winners")


def exact_dedup(docs: DataFrame, *, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256).

    keep_id is the largest id of the rows with the same text.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    narrow, winners = _split(docs, scratch, support, id_col, text_col)
    hot = narrow.join(F.broadcast(winners), "digest").select("id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("at")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    cold = (
        narrow.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("place", F.row_number().over(group.orderBy(F.desc_nulls_last("id"), F.desc("row"))))
        .select("id", F.max("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.col("place") == 1).alias("kept"), "digest")
    )
    return hot.unionByName(cold)


def drop_copies(docs: DataFrame, *, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that ``exact_dedup`` drops.

    Texts move only in the join that takes the dropped ids of the small groups away, and Spark
    broadcasts those where they are few. Copies of a winner never leave their map task.
    """
    scratch = Scratch(docs.sparkSession, "drop-copies")
    narrow, winners = _split(docs, scratch, support, id_col, text_col)
    names = set(docs.columns)
    fresh = {c: next(x for x in (f"_{c}{'_' * k}" for k in range(len(names) + 1)) if x not in names) for c in ("digest", "best", "hot", "id")}
    digest, best, hot, key = (fresh[c] for c in ("digest", "best", "hot", "id"))
    top = winners.select(F.col("digest").alias(digest), F.col("best").alias(best), F.lit(True).alias(hot))
    out = docs.withColumn(digest, _digest(text_col)).join(F.broadcast(top), digest, "left")
    out = out.where(F.col(hot).isNull() | F.col(id_col).eqNullSafe(F.col(best))).drop(best, hot)

    group = Window.partitionBy("digest")
    cold = narrow.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumn("keep_id", F.max("id").over(group)).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = cold.select(F.col("digest").alias(digest), F.col("id").alias(key))
    out = out.join(gone, (out[digest] == gone[digest]) & out[id_col].eqNullSafe(gone[key]), "left_anti")

    # Rows that repeat both text and id: one stays. Without any, nothing more is planned.
    again = narrow.groupBy("digest", "id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias(digest), F.col("id").alias(key))
    again = scratch.save(again, "repeated")
    if not again.isEmpty():
        same = lambda a: (a[digest] == again[digest]) & a[id_col].eqNullSafe(again[key])
        out = out.join(again, same(out), "left_anti").unionByName(out.join(again, same(out), "left_semi").dropDuplicates([digest, id_col]))
    return out.drop(digest)
