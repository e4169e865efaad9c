"""Stop rules over rows that come shuffled over many triggers."""

import random
import time

import pytest

from loomspark.operators import groups
from loomspark.streaming import stops

SCHEMA = "run string, step long, reward_std double, zero_std boolean, executable_rate double, marker_rate double, multiple_program_rate double, all_wrong boolean, loss double, norm double"


def trace(runs=12, steps=40, seed=2):
    rng = random.Random(seed)
    rows = []
    for r in range(runs):
        mood = rng.random()
        for i in range(1, steps + 1):
            low = rng.random() < mood
            rows.append((f"r{r}", i, 0.0 if low else rng.choice([1.0, None]), rng.random() < mood, rng.choice([0.2, 0.6, 1.0, None]), float(rng.random() < 0.004), float(rng.random() < mood / 2), rng.random() < 0.4, 1.0, float("inf") if rng.random() < 0.01 else 2.0))
    return rows


def run(spark, rows, tmp_path, files, **settings):
    per = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * per : (k + 1) * per], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stops.ROCKS)
    try:
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stops.ordered_stops(s, finite=("loss", "norm"), **settings).writeStream.format("memory").queryName(f"stops{files}").option("checkpointLocation", str(tmp_path / "cp")).start()
        # batches go on without data, for the timers: two more than the data takes
        until, full = time.monotonic() + 90, lambda: [p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0]
        while time.monotonic() < until and q.isActive and not (len(full()) == files and q.lastProgress["batchId"] >= full()[-1] + 2):
            time.sleep(0.2)
        assert q.exception() is None and len(full()) == files
        q.stop()
        return [(r["run"], r["step"], r["stop"]) for r in spark.table(f"stops{files}").collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_shuffled(spark, tmp_path):
    rows = trace()
    want = [(r["run"], r["step"], r["stop"]) for r in groups.early_stop(spark.createDataFrame(rows, SCHEMA), "run", "step", ("loss", "norm")).collect()]
    random.Random(3).shuffle(rows)
    got = run(spark, rows + rows[:20], tmp_path, 5)  # some rows come twice
    assert sorted(got, key=str) == sorted(want, key=str) and len({s for *_, s in got}) == 4


def test_idle(spark, tmp_path):
    """A gap that never fills: what waits behind it is judged once the run is idle."""
    rows = [r for r in trace(1, 30) if r[1] not in (7, 8)]
    later = [("other", i, *rows[0][2:]) for i in range(1, 4)]
    got = run(spark, rows + later * 3, tmp_path, 4, idle=0.001)
    # the run was over as soon as a trigger found it idle
    steps = sorted(s for r, s, _ in got if r == "r0")
    assert steps[:6] == [1, 2, 3, 4, 5, 6] and len(steps) == len(set(steps)) and 7 not in steps and 9 in steps


def test_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stops.ordered_stops(spark.createDataFrame([], SCHEMA))
