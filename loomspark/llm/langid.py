"""Language identification by hierarchical discrimination.

First the language's family is predicted, then one-versus-one linear support vector machines tell the
family's languages apart. Families are duelled one against one too. Features are hashed letter n-grams
(1 to 3, with word edges) and whole words, as shares of a text's features; words are scored once per
worker and kept in a bounded cache, since a text's decision values are sums over its words.

The machines are fitted by dual coordinate descent in one task, on a bounded sample: ``MOST_ROWS`` rows
of each language, by the hash of their id, whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, so is every text if nothing
could be learned. With one language learned, that is it, with score 1. Rows with a null language aren't
learned from. Repeated rows get equal predictions. Null ids take part. Columns beyond those named don't
matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded

# Languages (ISO 639-1) of the families that are told apart first; any other is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa ur",
    "celtic": "br cy ga gd",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
SLOTS = 1 << 16
MOST_ROWS = 800
SCALE, COST, EPOCHS = 20.0, 1.0, 8
_LETTERS = re.compile(r"[^\W\d_]+")
_KEPT = 300_000


def features(word: str) -> list[int]:
    text = f"<{word}>"
    grams = [text, *word, *(text[k : k + n] for n in (2, 3) for k in range(len(text) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & SLOTS - 1 for g in grams]


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with hinge loss, by dual coordinate descent.

    Costs are balanced between the two classes."""
    w, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(y))
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([v @ v + 1 for _, v in x])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(y)):
            i, v = x[k]
            a = min(max(alpha[k] - (y[k] * (w[i] @ v + bias) - 1) / norm[k], 0.0), cost[k])
            if (step := (a - alpha[k]) * y[k]) != 0:
                w[i] += step * v
                bias += step
                alpha[k] = a
    return w, bias


def fit(texts: list[str], langs: list[str]) -> dict:
    """duels: (one, other) of families or of languages -> column of the weights."""
    x = []
    for t in texts:
        counts: Counter = Counter()
        for w, n in Counter(_LETTERS.findall(t.lower())).items():
            for f in features(w):
                counts[f] += n
        total = max(1, sum(counts.values()))
        x.append((np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)) * SCALE / total))
    langs_of: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        langs_of.setdefault(FAMILY.get(lang, lang), []).append(lang)
    family = [FAMILY.get(lang, lang) for lang in langs]
    duels, weights, biases = [], [], []
    for kind, names, pairs in (("family", family, combinations(sorted(langs_of), 2)), *(("language", langs, combinations(ls, 2)) for ls in langs_of.values())):
        for one, other in pairs:
            rows = [k for k, n in enumerate(names) if n in (one, other)]
            w, b = svm([x[k] for k in rows], np.array([1.0 if names[k] == one else -1.0 for k in rows]))
            duels.append((kind, one, other))
            weights.append(w)
            biases.append(b)
    return {"families": langs_of, "duels": duels, "weights": np.array(weights).T.copy() if weights else np.zeros((SLOTS, 0)), "biases": np.array(biases)}


class Predictor:
    def __init__(self, model: dict):
        self.m, self._known = model, {}
        self._clear()

    def _clear(self):
        self._known.clear()
        self._rows, self._sizes = np.zeros((1024, len(self.m["duels"]))), np.zeros(1024)

    def _learn(self, words: set[str]) -> None:
        if len(self._known) + len(words) > _KEPT:
            self._clear()
        while len(self._rows) < len(self._known) + len(words):
            self._rows, self._sizes = np.concatenate([self._rows, self._rows * 0]), np.concatenate([self._sizes, self._sizes * 0])
        for w in words:
            k = len(self._known)
            f = features(w)
            self._rows[k], self._sizes[k] = self.m["weights"][f].sum(0), len(f)
            self._known[w] = k

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall((text or "").lower())
        if not words or not self.m["families"]:
            return "und", 0.0
        if new := set(words).difference(self._known):
            self._learn(new)
            new = set(words).difference(self._known)  # a clearing took words that were known
            if new:
                self._learn(new)
        at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        margins = self._rows[at].sum(0) * SCALE / self._sizes[at].sum() + self.m["biases"]
        family, sure = self._winner("family", sorted(self.m["families"]), margins)
        lang, surer = self._winner("language", self.m["families"][family], margins)
        return lang, min(sure, surer)

    def _winner(self, kind: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        won: dict[str, list[float]] = {n: [] for n in names}
        for (k, one, other), m in zip(self.m["duels"], margins, strict=True):
            if k == kind and one in won:
                won[one].append(m)
                won[other].append(-m)
        best = max(names, key=lambda n: (sum(m > 0 for m in won[n]), sum(won[n])))
        return best, float(1 / (1 + np.exp(-np.clip(2 * min(won[best]), -50, 50))))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    model = fit([t for *_, t in rows], [r[1] for r in rows])
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, use: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model from the rows with a language whose id satisfies ``use`` (a condition on the column ``id``)."""
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    d = d.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    ids = d.select("id", "lang", rank.alias("rank"))
    # a language's least ranks are below a threshold that its count gives; few rows meet in the window
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    at = F.conv(F.substring("rank", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    low = ids.join(F.broadcast(counts), "lang").where(at * F.col("n") < 4 * MOST_ROWS).select("id", "lang", "rank").distinct()
    first = Window.partitionBy("lang").orderBy("rank", "id")
    sample = low.withColumn("place", F.row_number().over(first)).where(F.col("place") <= MOST_ROWS)
    # at most MOST_ROWS rows a language: sent to the texts, which stay where they are
    s = F.broadcast(sample.select(F.col("id").alias("of"), F.col("lang").alias("as"), "rank"))
    # rows that repeat an id count once
    rows = d.join(s, d["id"].eqNullSafe(s["of"]) & (d["lang"] == s["as"])).groupBy("rank", "lang").agg(F.min("text").alias("text"))
    model = rows.coalesce(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit([], [])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model.value)
        for b in batches:
            found = [predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_predict(bounded(docs.sparkSession).sparkContext.broadcast(model)), f"id {d.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, model: dict, least: float, *, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose language is ``und`` or scored below ``least``.

    If nothing could be learned, no language can be rejected: only rows without a letter go."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)
    at, learned = docs.columns.index(text_col), bool(model["families"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Predictor(sent.value)
        for b in batches:
            if learned:
                kept = [lang != "und" and sure >= least for lang, sure in (guess(t.as_py()) for t in b.column(at))]
            else:
                kept = [bool(_LETTERS.search(t.as_py() or "")) for t in b.column(at)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
