"""The n best documents of each query, exactly, without scoring every pair that shares a word.

Words: postings are put into blocks by term and impact (a posting's share of a score, before the term's weight), and the
greatest share of each block is kept. A first bound of a query's n-th score comes from whole scores of the documents that are best by its heaviest terms.
In order of what they can add at most, a query's last terms cannot reach that bound together: they are not essential, and
a document needs one of the others. Only the blocks of essential terms are joined, but those whose maximum leaves all their documents below the bound. What a document has from
them, plus all the rest could add, decides whether it is a candidate, against the bound or the n-th best such partial score; the rest, common words mostly, is looked up for candidates alone.

Vectors: lists around pivots, each with its radius; a list is multiplied with those queries only that its nearest possible vector could serve.

Ties go to the smaller key; scores are compared rounded to ``DIGITS``. Null or empty texts have no words, and queries without words no result. Keys
that repeat are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Shared

#: Impact blocks a term, heaviest terms whose best documents bound a query's n-th score, decimals by which scores are compared.
BLOCKS, SEED_TERMS, DIGITS = 32, 4, 9
#: Share of the bound that the terms which are not essential may reach together. Below 1, more postings are joined and fewer documents are candidates.
REST = 0.25
#: Rows up to which the terms of the queries are broadcast.
BROADCAST_TERMS = 500_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1)


def _small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _best(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The n best rows of each ``by``, with their rank; Spark keeps n rows a task before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_bm25(docs: DataFrame, queries: DataFrame, n: int = 10, *, key: str = "doc_id", query: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank) of the n best documents of each query by BM25, of those that share a word with it.

    Counts and averages are of all documents. An action runs while the plan is built: postings of the queries' words are written once.
    """
    shared = Shared(docs.sparkSession, "top-bm25")
    asked = shared.save(queries.select(F.col(query).alias("query"), F.explode(words(F.col(text))).alias("term")).distinct(), "asked")
    length = docs.select(F.col(key).alias("key"), F.coalesce(F.size(words(F.col(text))), F.lit(0)).alias("len")).groupBy("key").agg(F.count("*").alias("rows"), F.sum("len").alias("len"))
    length = shared.save(length, "length")
    rows, mean = length.agg(F.sum("rows"), F.avg(F.when(F.col("len") > 0, F.col("len")))).first()
    hits = docs.select(F.col(key).alias("key"), F.explode(words(F.col(text))).alias("term")).join(_small(asked.select("term").distinct()), "term", "left_semi")
    hits = hits.groupBy("key", "term").agg(F.count("*").alias("tf"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    block = F.least(F.floor(F.col("share") * (BLOCKS / (k1 + 1))), F.lit(BLOCKS - 1)).cast("int")
    postings = shared.save(hits.join(length.drop("rows"), "key").select("key", "term", share.alias("share")).withColumn("block", block), "postings")

    blocks = shared.save(postings.groupBy("term", "block").agg(F.max("share").alias("top"), F.count("*").alias("n")), "blocks")
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    idf = F.log((F.lit(rows or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = Window.partitionBy("query").orderBy(F.desc("most"), "term")
    weights = asked.join(terms, "term").select("query", "term", idf.alias("idf"), (idf * F.col("top")).alias("most"))
    weights = weights.withColumn("place", F.row_number().over(w)).withColumn("after", F.coalesce(F.sum("most").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    weights = shared.save(weights, "weights")

    def scored(pairs: DataFrame) -> DataFrame:
        """Whole scores of pairs: their queries' terms are looked up among the documents' postings."""
        wanted = pairs.join(_small(weights.select("query", "term", "idf")), "query")
        return wanted.join(postings.select("key", "term", "share"), ["key", "term"]).groupBy("query", "key").agg(F.round(F.sum(F.col("idf") * F.col("share")), DIGITS).alias("score"))

    heavy = _small(weights.where(F.col("place") <= SEED_TERMS).select("query", "term", "idf"))
    seeds = postings.select("key", "term", "share").join(heavy, "term").groupBy("query", "key").agg(F.round(F.sum(F.col("idf") * F.col("share")), DIGITS).alias("score"))
    seeds = shared.save(_best(seeds, "query", n, "key").select("query", "key"), "seeds")
    bound = _best(scored(seeds), "query", n, "key").where(F.col("rank") == n).select("query", F.col("score").alias("bound"))

    # Essential are a query's heaviest terms, until those after them cannot reach the bound together; a document below the bound in all of its blocks is left out.
    w = Window.partitionBy("query")
    bounded = weights.join(_small(bound), "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) * (1 - 1e-9) - 10.0**-DIGITS)
    bounded = bounded.withColumn("essential", F.col("most") + F.col("after") >= F.col("bound") * REST).withColumn("all", F.sum("most").over(w)).withColumn("rest", F.min(F.when(F.col("essential"), F.col("after"))).over(w))
    bounded = shared.save(bounded, "bounded")
    open_ = bounded.where("essential").join(blocks.select("term", "block", "top"), "term").where(F.col("all") - F.col("most") + F.col("idf") * F.col("top") >= F.col("bound"))
    open_ = open_.select("query", "term", "block", "idf", "rest", "bound")
    part = postings.join(_small(open_), ["term", "block"]).groupBy("query", "key", "rest", "bound").agg(F.sum(F.col("idf") * F.col("share")).alias("part"))
    part = shared.save(part.where(F.col("part") + F.col("rest") >= F.col("bound")).withColumnRenamed("part", "score"), "partial")
    # a query's n-th best partial score bounds its n-th whole score once more
    raised = _best(part.select("query", "key", "score"), "query", n, "key").where(F.col("rank") == n).select("query", (F.col("score") * (1 - 1e-9) - 10.0**-DIGITS).alias("raised"))
    part = part.join(_small(raised), "query", "left").where(F.col("score") + F.col("rest") >= F.coalesce("raised", "bound"))
    part = shared.save(part.select("query", "key", F.col("score").alias("part")), "candidates")
    # the other terms are looked up for the candidates alone
    more = part.select("query", "key").join(_small(bounded.where("not essential").select("query", "term", "idf")), "query").join(postings.select("key", "term", "share"), ["key", "term"])
    more = more.groupBy("query", "key").agg(F.sum(F.col("idf") * F.col("share")).alias("more"))
    whole = part.join(more, ["query", "key"], "left").select("query", "key", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), DIGITS).alias("score"))
    return _best(whole, "query", n, "key").select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")


# Vectors

#: Pivots at most, and queries that are broadcast at a time.
PIVOTS, QUERIES = 256, 2048


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _keep(best: dict, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, n: int) -> None:
    """Merges the scores (queries x rows) into each query's n best (score, key)."""
    for i, q in enumerate(ids):
        s = scores[i]
        near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n]) if len(s) > n else np.arange(len(s))
        both = best.get(q, []) + [(-round(float(s[j]), DIGITS), int(rows[j])) for j in near]
        best[q] = sorted(both)[:n]


def top_dense(vectors: DataFrame, queries: DataFrame, n: int = 10, *, key: str = "vec_id", query: str = "query", vector: str = "embedding", most: int = QUERIES, pivots: int = PIVOTS) -> DataFrame:
    """(query, key, score, rank) of the n vectors with the greatest dot product for each query, but a vector of the query's own key.

    Keys are integers, ``queries`` has ``query`` (their own keys) and ``vector``. Vectors of another length than the queries', null or with parts that
    aren't finite are left out. Queries go in blocks of ``most``; of each, every task returns n rows at most. An action runs while the plan is built.
    """
    spark = vectors.sparkSession
    shared = Shared(spark, "top-dense")
    x = F.col("x")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    clean = lambda d, k: d.select(F.col(k).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")).where(good)
    rows, asked = clean(vectors, key), clean(queries, query)
    out = f"{query} long, {key} long, score double, rank int"
    width = asked.select(F.size("x")).first()
    if width is None:
        return spark.createDataFrame([], out)
    width = width[0]
    rows, asked = rows.where(F.size("x") == width), asked.where(F.size("x") == width)
    # pivots: the vectors with the least hashes
    centre = rows.orderBy(F.xxhash64("key"), "key").limit(pivots).collect()  # at most ``pivots``
    if not centre:
        return spark.createDataFrame([], out)
    centres = np.array([r["x"] for r in centre])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("x"), width)
            gap = (m * m).sum(1)[:, None] - 2 * m @ centres.T + (centres * centres).sum(1)
            own = gap.argmin(1)
            far = np.linalg.norm(m - centres[own], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("x"), pa.array(own.astype(np.int32)), pa.array(far)], names=["key", "x", "list", "far"])

    lists = rows.mapInArrow(listed, "key long, x array<double>, list int, far double")
    lists = shared.save(lists.repartitionByRange("list", "far", "key").sortWithinPartitions("list"), "lists")
    radius = np.zeros(len(centres))
    for r in lists.groupBy("list").agg(F.max("far").alias("far")).collect():  # at most ``pivots``
        radius[r["list"]] = r["far"]
    total, found = asked.count(), None
    for part in range(-(-total // most)):
        block = asked.orderBy("key").offset(part * most).limit(most).collect()  # at most ``most``
        ids, qs = np.array([r["key"] for r in block]), np.array([r["x"] for r in block])
        # no vector of a list has a greater product than this
        reach = (qs @ centres.T + np.linalg.norm(qs, axis=1)[:, None] * radius) * (1 + 1e-12) + 10.0**-DIGITS

        def search(batches: Iterator[pa.RecordBatch], ids=ids, qs=qs, reach=reach) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {}
            bound = np.full(len(ids), -np.inf)
            for b in batches:
                m, keys, lists_ = _matrix(b.column("x"), width), b.column("key").to_numpy(), b.column("list").to_numpy()
                for k in np.unique(lists_):
                    at, who = np.flatnonzero(lists_ == k), np.flatnonzero(reach[:, k] >= bound)
                    if len(who) and len(at):
                        scores = np.where(ids[who][:, None] == keys[at][None, :], -np.inf, qs[who] @ m[at].T)
                        _keep(best, ids[who], keys[at], scores, n)
                        for i in who:
                            own = best[ids[i]]
                            bound[i] = -own[-1][0] if len(own) == n else -np.inf
            flat = [(q, k, -s) for q, own in best.items() for s, k in own if s < np.inf]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["query", "key", "score"])

        here = lists.mapInArrow(search, "query long, key long, score double")
        found = here if found is None else found.unionByName(here)
    return _best(found, "query", n, "key").select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")
