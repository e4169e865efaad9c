"""Two-key dedupe against the ordered pass."""

import random

import pytest

from loomspark.operators import relations


def ordered(rows):
    keys, prompts, out = set(), set(), []
    for k, p, at in sorted(rows, key=lambda r: r[2]):
        if k not in keys and p not in prompts:
            keys.add(k)
            prompts.add(p)
            out.append(at)
    return out


def run(spark, rows, **settings):
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, prompt string, ord long").repartition(4)
    return sorted(r["ord"] for r in relations.sequential_dedupe(df, "key", "prompt", "ord", **settings).collect())


def test_long_chain(spark):
    rows = [(f"k{i // 2}", f"p{(i + 1) // 2}", i) for i in range(10_000)]
    assert run(spark, rows) == ordered(rows) == list(range(0, 10_000, 2))


@pytest.mark.parametrize("one_task", [relations.ONE_TASK, 0])
def test_random(spark, one_task):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", None, f"k{rng.randint(0, 60)}", f"k{i}"]), rng.choice(["warm", None, f"p{rng.randint(0, 60)}", f"p{i}"]), 3 * i) for i in range(900)]
    assert run(spark, rows, one_task=one_task) == ordered(rows)


def test_stairs(spark):
    """Rows with several before them, on and on: components decide what rounds would take hundreds of steps for."""
    rows = [(f"k{i // 3}", f"p{(i + 1) // 3 * 2 + i % 2}", i) for i in range(1500)]
    assert run(spark, rows) == ordered(rows)
    assert run(spark, rows[:0]) == []
