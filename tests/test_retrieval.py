"""The n best of a query against scores of all pairs."""

import math
import random

import numpy as np

from loomspark.operators import retrieval, sequences


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(n)]


def test_bm25(spark):
    rows = texts(400, 1)
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None), (2001, ""), (2002, "…"), rows[5]]  # ties, no words, a repeated key
    asked = [(i, t) for i, t in texts(30, 2)] + [(40, rows[3][1]), (41, None), (42, "unseen words"), (43, "w0"), (44, "w399")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    every = {}
    for r in sequences.bm25(docs, queries).collect():
        every.setdefault(r["item_id"], []).append((-round(r["score"], 9), r["doc_id"]))
    want = {(q, k, i + 1) for q, scores in every.items() for i, (_, k) in enumerate(sorted(scores)[:7])}
    for n in (1, 7):
        got = {(r["item_id"], r["doc_id"], r["rank"]) for r in retrieval.top_bm25(docs, queries, n).collect()}
        assert got == {w for w in want if w[2] <= n}
    assert retrieval.top_bm25(docs.limit(0), queries).count() == 0 and retrieval.top_bm25(docs, queries.limit(0)).count() == 0


def test_dense(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 8))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(600 + i, [float(e) for e in x[i]]) for i in range(15)]
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [math.nan] * 8), (904, [None] * 8), (905, [math.inf] * 8), (906, [0.0] * 8)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    queries = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query")
    good = [*rows, odd[-1]]
    want = set()
    for q, y in good:
        if q % 10 == 0:
            scored = sorted((-round(float(np.dot(np.array(y), np.array(v))), 9), k) for k, v in good if k != q)
            want |= {(q, k, i + 1) for i, (_, k) in enumerate(scored[:5])}
    for most in (7, 2048):
        got = {(r["query"], r["vec_id"], r["rank"]) for r in retrieval.top_dense(vectors, queries, 5, most=most, pivots=16).collect()}
        assert got == want
    assert retrieval.top_dense(vectors.limit(0), queries).count() == 0 and retrieval.top_dense(vectors, queries.limit(0)).count() == 0
