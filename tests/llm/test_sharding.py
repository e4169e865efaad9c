"""op13 against a search over all capacities, on whole tables and on profiles alone."""

import hashlib
import random
import zlib

import pytest

from loomspark.llm import shard_cuts
from loomspark.llm.shard_cuts import Profile, minimax

SCHEMA = "doc_id long, text string, id string, size int, digest string, shard int, slot int, row int, range int, place int, prefix string"
EXTRA = ("i", 1, "d", 2, 3, 4, 5, 6, "p")


def greedy(sizes, capacity):
    n, fill = 1, 0
    for s in sizes:
        if s > capacity:
            return len(sizes) + 1
        if fill + s > capacity:
            n, fill = n + 1, 0
        fill += s
    return n


def least_capacity(sizes, k):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(sizes, mid) <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(12))
def test_profile_finds_the_least_capacity(seed):
    """Groups behind prefixes of uneven depth, some of them giants; refinement sees only what it asks for."""
    rng = random.Random(seed)
    groups = {hashlib.sha256(str((seed, i)).encode()).hexdigest().upper(): rng.choice([16, 20, 500, rng.randint(17, 4000)]) for i in range(rng.choice([3, 40, 700, 6000]))}
    for g in rng.sample(sorted(groups), min(seed % 4, len(groups))):
        groups[g] = sum(groups.values()) // 3

    def summed(n, of=None):
        made = {}
        for d, s in groups.items():
            if of is None or d[: n - 2] in of:
                made.setdefault(d[:n], []).append(s)
        return [(p, sum(v), len(v), max(v)) for p, v in made.items()]

    seen = []

    def refine(these):
        seen.append(len(these))
        return [r for n in {len(p) for p in these} for r in summed(n + 2, {p for p in these if len(p) == n})]

    for k in (1, 2, 7, 40):
        capacity, begins = minimax(Profile(summed(1)), k, refine)
        order = sorted(groups)
        sizes = [groups[d] for d in order]
        assert capacity == least_capacity(sizes, k)
        filled = [0] * k
        for d in order:
            filled[sum(b <= d for b in begins)] += groups[d]
        assert max(filled) == capacity and (len(order) < k or min(filled) > 0 or max(sizes) * k > sum(sizes))
    assert max(seen, default=0) <= shard_cuts.AT_ONCE


def test_shard(spark):
    rng = random.Random(5)
    texts = ["word " * rng.randint(0, 60) + str(i) for i in range(400)] + ["copy of many"] * 300 + [None, "", "", "é" * 500]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], *EXTRA), (None, None, *EXTRA)]
    cut, capacity = shard_cuts.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), 9)
    got = cut.collect()
    assert len(got) == len(rows)
    by_text, filled, slots = {}, {}, {}
    size = lambda t: len((t or "").encode()) + 16
    text_of = {hashlib.sha256((t or "").encode()).digest(): t or "" for _, t, *_ in rows}
    for r in got:
        t = text_of[bytes(r["digest"])]
        assert r["size"] == size(t) and r["text_crc32"] == zlib.crc32(t.encode())
        by_text.setdefault(t, set()).add(r["shard"])
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], bytes(r["digest"])))
    assert all(len(s) == 1 for s in by_text.values()) and set(filled) == set(range(9))
    for s in slots.values():
        assert sorted(x for x, _ in s) == list(range(len(s))) and [d for _, d in sorted(s)] == sorted(d for _, d in s)
    groups = {}
    for _, t, *_ in rows:
        d = hashlib.sha256((t or "").encode()).hexdigest()
        groups[d] = groups.get(d, 0) + size(t)
    assert capacity == max(filled.values()) == least_capacity([groups[d] for d in sorted(groups)], 9)
    assert sorted((str(r["id"]), r["shard"]) for r in got) == sorted((str(r["id"]), r["shard"]) for r in cut.collect())


def test_none_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    cut, capacity = shard_cuts.shard(none)
    assert cut.count() == 0 and capacity == 0
    cut, capacity = shard_cuts.shard(spark.createDataFrame([(1, "a", *EXTRA), (2, "b", *EXTRA)], SCHEMA), 40)
    assert capacity == 17 and len({r["shard"] for r in cut.collect()}) == 2
