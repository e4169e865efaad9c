"""op11 against Lloyd's plain rounds, on ties, clashes and input that isn't kept."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomspark.llm import elkan

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, cluster string, square int, lower int"
EXTRA = (1, 2, "x", "c", 3, 4)


def vectors(width, n, spread, seed=3, centres=9):
    rng = random.Random(seed)
    mids = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(centres)]
    out = [(i, [m + rng.gauss(0, spread) for m in mids[i % centres]]) for i in range(n)]
    out += [(n + i, list(out[i % 5][1])) for i in range(60)]  # many copies: equal vectors, equal first centroids, ties
    out += [out[7], out[7], (None, out[3][1])]
    odd = [None, [], [0.5] * (width - 1), [0.5] * (width + 1), [None] + [0.5] * (width - 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1), [1e30] + [0.0] * (width - 1)]
    return [(i, [float(np.float32(e)) for e in v]) for i, v in out], [(9000 + i, v) for i, v in enumerate(odd)]


def lloyd(rows, k, rounds, scale):
    x = [(i, [math.floor(scale * e) for e in v]) for i, v in rows]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in x]
        for j in range(len(cents)):
            own = [v for (_, v), c in zip(x, got, strict=True) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in x), cents


@pytest.mark.parametrize(("width", "scale", "spread", "k"), [(64, 64, 0.05, 16), (64, 64, 1.0, 16), (3, 2, 0.4, 16), (2, 1, 1.5, 5), (64, 1 << 20, 0.3, 16)])
def test_equals_lloyd(spark, width, scale, spread, k):
    good, odd = vectors(width, 300, spread)
    df = spark.createDataFrame([(*r, *EXTRA) for r in good + odd], SCHEMA).repartition(3)
    found, cents = elkan.elkan(df, k=k, width=width, scale=scale)
    rows = found.collect()
    want, centres = lloyd(good, k, 3, scale)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in rows) == want and cents == centres
    assert all(1 <= r["calculated"] <= k * 4 for r in rows)
    if spread == 0.05:
        assert sum(r["calculated"] for r in rows) < 0.8 * len(rows) * k * 4  # bounds skip calculations
    whole = elkan.with_inertia(found, cents).collect()
    assert len(whole) == len(rows)
    for r in whole:
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_bounds_round_outwards():
    sq = np.array([2, 3, 5, 10**12 + 1, (1 << 61) + 12345, 0], np.int64)
    for s, lo, hi in zip(sq, elkan.below(sq), elkan.above(sq), strict=True):
        root = math.isqrt(int(s) << 200)  # floor of sqrt(s) * 2**100
        assert lo * 2.0**100 <= root + 1 and hi * 2.0**100 >= root


def test_few_and_none(spark):
    one = spark.createDataFrame([(5, [0.5] * 64, *EXTRA), (6, None, *EXTRA)], SCHEMA)
    found, cents = elkan.elkan(one)
    assert [(r["id"], r["cluster"], r["distance"]) for r in found.collect()] == [(5, 0, 0)] and cents == [[32] * 64]
    found, cents = elkan.elkan(one.limit(0))
    assert found.count() == 0 and elkan.with_inertia(found, cents).count() == 0
