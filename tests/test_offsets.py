"""Running sums and lowest rows of groups against plain sorting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import offsets, sampling, sequences
from loomspark.sources.shared import Shared

SCHEMA = "id long, s string, t string, n int"


def rows(seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice(["x", None]), rng.randint(0, 5)) for i in range(3000)]


@pytest.fixture
def many(spark):
    """Shuffles of many partitions, which aren't merged."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_running(many):
    data = rows() + [(None, "b", "x", 2), (None, None, "x", 3)]
    df = many.createDataFrame(data, SCHEMA).repartition(5)
    at = offsets.running(df, F.col("s"), "id", F.col("n"), Shared(many, "test"))
    got = {(r["g"]["v"], r["id"]): (r["n"], r["at"], r["total"]) for r in at.collect()}
    want = {}
    for s in ("hot", "b", "c", None):
        own, sum_ = sorted((r for r in data if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0)), 0
        for r in own:
            want[s, r[0]] = (r[3], sum_, sum(x[3] for x in own))
            sum_ += r[3]
    assert got == want
    assert offsets.running(df.limit(0), F.col("s"), "id", F.col("n"), Shared(many, "test")).count() == 0


@pytest.mark.parametrize("leaf", [1, 7, 1024])
def test_lowest(many, monkeypatch, leaf):
    monkeypatch.setattr(offsets, "LEAF", leaf)
    data = rows(2)
    df = many.createDataFrame(data, SCHEMA).repartition(5)
    quota = {("hot", "x"): 500, ("hot", None): 1, ("b", "x"): 0, ("b", None): 10**6, (None, None): 20}  # other strata have no quota
    wanted = many.createDataFrame([(*k, q) for k, q in quota.items()], "s string, t string, quota long")
    got = {r["id"]: r["in"] for r in offsets.mark_lowest(df, ["s", "t"], wanted, sampling.order_key(3, F.col("id")), ["id"], "in").collect()}
    want = {}
    for s in ("hot", "b", "c", None):
        for t in ("x", None):
            own = sorted((r[0] for r in data if r[1:3] == (s, t)), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
            want |= {i: k < quota.get((s, t), 0) for k, i in enumerate(own)}
    assert got == want
    assert sampling.stratified(df.limit(0), ["s"], 5, 1, "id").count() == 0
    assert sampling.phases(df, 3, ["s", "t"], 1, "id").where("phase = 'pilot'").count() == 3 * 8


def test_pack(many):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot"] * 5 + [None, "b"]), [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 40, 300]))]) for i in range(200)] + [(900, "tiny", [7]), (901, "b", None), (902, "b", [5, 6]), (902, "b", [5, 6])]
    df = many.createDataFrame(data, "id long, s string, tokens array<int>").repartition(4)
    for eos in (0, None):
        got = {(r["s"], r["block"]): r["tokens"] for r in sequences.pack(df, "tokens", "id", "s", 16, eos).collect()}
        want = {}
        for s in ("hot", None, "b", "tiny"):
            flat = [x for i, g, t in sorted(data, key=lambda r: r[0]) if g == s for x in (t or []) + ([eos] if eos is not None else [])]
            if flat and len(flat) < 16:
                want[s, 0] = flat
            want |= {(s, k): flat[16 * k : 16 * k + 16] for k in range(len(flat) // 16)}
        assert got == want
