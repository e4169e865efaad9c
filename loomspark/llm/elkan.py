"""Lloyd's clustering around centroids with Elkan's bounds, exact on integers.

Vectors become integers once, by ``floor(scale * x)``; every centroid is a vector of integers too, so squared
distances and sums are exact and reruns agree. A row keeps an upper bound of the distance to its own centroid
and a lower bound of that to every centroid. When the centroids move, the bounds move with them, and most
distances need no calculation:

* a row whose upper bound is below half the distance from its centroid to the next centroid keeps it;
* centroid ``j`` is skipped where the upper bound is below ``lower[j]`` or below half the distance between
  the row's centroid and ``j``.

Both tests are strict, upper bounds round up and lower ones down, so whatever could win or tie is calculated,
as an integer. Among equal distances the smaller number wins.

A round is one pass over the rows (Arrow batches, ``k`` centroids in the closure) that writes the rows with their
bounds, and one native aggregate, combined map-side, for the sums of the clusters. To the driver come ``k`` rows a
round. No vector is shuffled.

Defined cases: only vectors of exactly ``width`` components, none of them null or non-finite, are kept; so a null or
empty vector isn't, nor one with a component of ``LIMIT`` or more in size (squared distances would not fit a long).
Rows that repeat, also in their id, count once each. A null id hashes as the empty text. With fewer kept vectors than
centroids, every kept vector starts one. Equal centroids may arise; the smaller number takes their rows, the other stays
empty and where it is. Columns beyond the id and the vector don't matter, whatever their names. Without kept vectors the
result is empty. Sums that a long cannot hold are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Components at or beyond this size, once scaled, leave their vector out: 64 squared differences and the sums of 2**37 rows fit a long.
LIMIT = 1 << 26
#: Relative slack of a bound after one more operation in double precision; each errs by at most 2**-53.
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def integers(vectors: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x: array<int>) of the kept vectors."""
    vec = F.col("vec")
    good = (F.size(vec) == width) & F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float(LIMIT) / scale)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.where(good).select("id", F.when(good, F.transform(vec, lambda e: F.floor(e * scale).cast("int"))).alias("x"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * _UP


def below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * _DOWN


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New clusters, exact squared distances and the number of distances calculated of each row. ``upper`` and ``lower`` are tightened in place.

    A squared distance is -1 where the bounds alone showed that the row stays.
    """
    k = len(centroids)
    between = np.stack([below(squares(centroids, c)) for c in centroids]) / 2
    np.fill_diagonal(between, np.inf)
    near = between.min(axis=1)
    cluster, work, square = cluster.copy(), np.zeros(len(x), np.int32), np.full(len(x), -1, np.int64)
    open_ = np.flatnonzero(~(upper < near[cluster]))
    own = squares(x[open_], centroids[cluster[open_]])
    square[open_], upper[open_], lower[open_, cluster[open_]] = own, above(own), below(own)
    work[open_] += 1
    for j in range(k):
        at, a = open_, cluster[open_]
        at = at[(a != j) & ~(upper[at] < lower[at, j]) & ~(upper[at] < between[a, j])]
        if len(at):
            to_j = squares(x[at], centroids[j])
            lower[at, j] = below(to_j)
            work[at] += 1
            wins = (to_j < square[at]) | ((to_j == square[at]) & (j < cluster[at]))
            won = at[wins]
            cluster[won], square[won], upper[won] = j, to_j[wins], above(to_j[wins])
    return cluster, square, work


def _pass(centroids: np.ndarray, moved: np.ndarray | None, names: list[str], types: pa.Schema, last: bool) -> Callable:
    """A pass over the rows: bounds follow ``moved`` (how far each centroid went; None before the first), then rows are assigned anew."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width)
            if moved is None:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster = b.column("cluster").to_numpy(zero_copy_only=False)
                lower = np.maximum(b.column("lower").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, k) - moved, 0) * _DOWN
                upper = (b.column("upper").to_numpy(zero_copy_only=False) + moved[cluster]) * _UP
            cluster, square, work = assign(x, cluster, upper, lower, centroids)
            if last:  # what the bounds decided gets its distance now
                left = np.flatnonzero(square < 0)
                square[left] = squares(x[left], centroids[cluster[left]])
            if moved is not None:
                work = work + b.column("calculated").to_numpy(zero_copy_only=False)
            narrow = np.nextafter(lower.astype(np.float32), np.float32(-np.inf)).clip(min=0)
            made = {
                "id": b.column("id"), "x": b.column("x"), "cluster": pa.array(cluster.astype(np.int32)), "upper": pa.array(upper), "square": pa.array(square), "calculated": pa.array(work.astype(np.int32)),
                "lower": pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(narrow.reshape(-1))),
            }
            yield pa.RecordBatch.from_arrays([made[c].cast(types.field(c).type) if c != "id" else made[c] for c in names], names=names)

    return run


_TYPES = pa.schema([("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float32())), ("square", pa.int64()), ("calculated", pa.int32())])


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return above(squares(old, new))


def elkan(
    vectors: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance, calculated) of the kept vectors, and the final centroids.

    Centroids start as the ``k`` kept vectors with the smallest sha256 of ``seed:id``. Each round assigns, then moves each
    centroid to the floor of the mean of its rows; at the end rows are assigned once more. ``distance`` is squared;
    ``calculated`` says how many distances of ``k * (rounds + 1)`` the row needed, but the last one that only reports.
    """
    scratch = Scratch(vectors.sparkSession, "elkan")
    rows = scratch.save(integers(vectors, width, scale, id_col, vector_col), "integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    out = rows.select(F.col("id"), "x", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.array().cast("array<float>").alias("lower"), F.lit(0).cast("long").alias("square"), F.lit(0).alias("calculated"))
    if not first:
        return out.select("id", "cluster", F.col("square").alias("distance"), "calculated"), []
    centroids, moved, state = np.array([r["x"] for r in first], np.int64), None, rows
    for n in range(rounds + 1):
        state = scratch.save(state.mapInArrow(_pass(centroids, moved, out.columns, _TYPES, n == rounds), out.schema), "state")
        scratch.drop("state")
        if n < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width))).collect()  # at most k rows
            new = centroids.copy()
            for r in sums:
                new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
            moved, centroids = _moved(centroids, new), new
    return state.select("id", "cluster", F.col("square").alias("distance"), "calculated"), centroids.tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256: one row a cluster, of at most k, is joined back."""
    spark = found.sparkSession
    named = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # at most k rows
    total = sum(int(r["part"]) for r in sums)
    parts = {r["cluster"]: int(r["part"]) for r in sums}
    table = spark.createDataFrame([(j, h, str(parts.get(j, 0)), str(total)) for j, h in named], "cluster int, centroid_sha256 string, part string, total string")
    table = table.select("cluster", long("part").alias("cluster_inertia"), long("total").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(table), "cluster")
