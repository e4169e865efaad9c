"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one or two words
between them, in ``DIMENSIONS`` slots. The model is fitted in one task on a bounded sample of labelled
rows (``MOST_ROWS`` of each class, by the hash of the id, weighted back to the class's real share).
Every coordinate has its own rate; the L1 term leaves few weights other than 0, at most ``DIMENSIONS``,
which are broadcast to score all texts.

Defined cases: a null text counts as empty; an empty text has the score of the bias. Rows without a
label aren't learned from; of several labels for an id the highest counts; null ids match no label.
Repeated rows get equal scores. Without labels of both classes all scores are 0. Columns beyond id and
text don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

DIMENSIONS = 1 << 20
MOST_ROWS = 6000
ALPHA, BETA, L2 = 1.0, 1.0, 0.02
#: The L1 term for a sample of n rows is this times the root of n; epochs make up for a small sample.
L1_ROOT, ROW_VISITS = 0.2, 40_000
_WORD = re.compile(r"\w+")
_KEPT = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    def __init__(self):
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Slots of the text's features, with repeats."""
        words = _WORD.findall((text or "").lower())
        known = self._known
        if len(known) > _KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        parts = [h]
        for gap in (1, 2, 3):
            if len(h) > gap:
                parts.append((h[:-gap] * _ODD ^ h[gap:] + np.uint64(gap)) * _ODD)
        return (np.concatenate(parts) >> np.uint64(44)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the coordinates other than 0. The order of the rows matters."""
    seen = np.bincount(np.concatenate(rows), minlength=DIMENSIONS) if rows else np.zeros(DIMENSIONS, int)
    often = seen > 1
    rows = [r[often[r]] for r in rows]
    z, n, w = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    strength = L1_ROOT * max(1, len(rows)) ** 0.5
    for _ in range(min(30, max(5, ROW_VISITS // max(1, len(rows))))):
        for r, y, weight in zip(rows, labels, weights, strict=True):
            i = np.append(r, DIMENSIONS)  # the bias, without L1
            zi, ni = z[i], n[i]
            l1 = np.full(len(i), strength)
            l1[-1] = 0
            root = np.sqrt(ni)
            wi = np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - y) * weight
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * wi
            n[i] = ni + g * g
    l1 = np.full(DIMENSIONS + 1, strength)
    l1[-1] = 0
    w = np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    slots = np.flatnonzero(w[:-1]).astype(np.int32)
    return slots, w[slots], float(w[-1])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        found = [np.unique(features(t)) for t in b.column(3).to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["rank", "label", "weight", "slots"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for b in batches:
        values, ends = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
        rows += [(*r, values[ends[k] : ends[k + 1]]) for k, r in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))]
    rows.sort(key=lambda r: r[0])
    slots, w, bias = fit([r[3] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))
    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(slots, -1), pa.int32()), "w": pa.array(np.append(w, bias), pa.float64())})


def train(docs: DataFrame, labels: DataFrame, use: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model from the labelled rows whose id satisfies ``use`` (a condition on the column ``id``)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(use)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rank = F.md5(F.col("id").cast("string"))
    sample = None
    for label, n in sorted(counts.items()):
        part = known.where(F.col("label") == label).withColumn("rank", rank).orderBy("rank", "id").limit(MOST_ROWS).withColumn("weight", F.lit(max(1.0, n / MOST_ROWS)))
        sample = part if sample is None else sample.unionByName(part)
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most 2 * MOST_ROWS ids; rows that repeat an id count once
    chosen = texts.join(F.broadcast(sample), "id").select("rank", "label", "weight", "text")
    rows = chosen.mapInArrow(_featurize, "rank string, label int, weight double, slots array<int>").dropDuplicates(["rank"])
    model = rows.coalesce(1).mapInArrow(_fit, "slot int, w double").toArrow()
    if not len(model):
        return None
    slot, w = model.column("slot").to_numpy(), model.column("w").to_numpy()
    return slot[slot >= 0], w[slot >= 0], float(w[slot < 0][0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    if model is None:
        return d.select("id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w, bias = sent.value
        dense = np.zeros(DIMENSIONS, np.float64)
        dense[slots] = w
        features = Features()

        def one(text: str | None) -> float:
            f = features(text)
            f = np.unique(f[dense[f] != 0])
            return float(1 / (1 + np.exp(-np.clip(bias + dense[f].sum(), -500, 500))))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t.as_py()) for t in b.column(1)], pa.float64())], ["id", "score"])

    return d.mapInArrow(run, f"id {kind}, score double")
