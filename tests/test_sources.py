"""Files in splits, and the source of committed parts in batches and streams."""

import glob
import os
import random

import pyarrow as pa
import pytest

from loomspark.sources import committed, readers


def test_lines_of_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [rng.choice(["", "  ", "x" * rng.randint(1, 300), f"line {i}", "é" * 20]) for i in range(4000)]
        lines[100] = "y" * 40_000  # over several splits
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
        want |= {(name, i + 1): x for i, x in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = readers.read_numbered(spark, str(tmp_path), keep_blank=True)
        assert got.rdd.getNumPartitions() > 30
        rows = {(os.path.basename(r["file"]), r["line_no"]): r["line"] for r in got.collect()}
        shown = lambda d: {k: v for k, v in d.items() if v.strip(" ")}
        assert shown(rows) == shown(want) and len(got.collect()) == len(rows)
        assert all(v == want[k] for k, v in rows.items() if k in want)
        some = readers.read_numbered(spark, str(tmp_path))
        assert {(os.path.basename(r["file"]), r["line_no"]) for r in some.collect()} == set(shown(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def rows(spark):
    committed.register(spark)
    return spark.range(0, 1000, 1, 4).selectExpr("id", "cast(id % 7 as string) AS name", "array(id, id + 1) AS pair")


def read(spark, path, schema):
    return spark.read.format("loom_commits").schema(schema).option("path", path).load()


def test_batches(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    save = lambda df, mode="append": df.write.format("loom_commits").option("path", path).option("part_rows", 100).mode(mode).save()
    save(rows)
    got = read(spark, path, rows.schema)
    assert got.rdd.getNumPartitions() >= 10 and sorted(got.collect()) == sorted(rows.collect())
    assert read(spark, path, "name string, id long").where("id < 3").count() == 3
    # a job that fails half-way leaves nothing to see, and its repetition no repeats
    with pytest.raises(Exception, match="stop here"):
        save(rows.selectExpr("id", "if(id = 999, raise_error('stop here'), name) AS name", "pair"))
    assert got.count() == 1000
    save(rows.where("id < 10"))
    assert read(spark, path, rows.schema).count() == 1010
    save(rows.where("id < 5"), "overwrite")
    assert read(spark, path, rows.schema).count() == 5
    save(rows.where("id < 0"))
    assert read(spark, path, rows.schema).count() == 5
    with pytest.raises(Exception, match="path is missing"):
        rows.write.format("loom_commits").mode("append").save()


def test_repeated_task(tmp_path):
    """The driver hears of one attempt of a task; the parts of the other aren't read."""
    w = committed.BatchWriter({"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3]})
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    w.commit([kept, None])
    assert lost.files != kept.files and [p.file for p in w.table.parts(0, w.table.commits())] == kept.files
    w.abort([lost])
    assert len(glob.glob(f"{tmp_path}/part-*")) == 1
    s = committed.StreamWriter({"path": str(tmp_path)}, False)
    for _ in range(2):  # a batch that is committed again after a failure
        s.commit([s.write(iter([batch]))], 0)
    assert s.table.commits() == 2 and len(glob.glob(f"{tmp_path}/part-*")) == 2


def test_streams(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    add = lambda a, b: rows.where(f"id >= {a} and id < {b}").write.format("loom_commits").option("path", source).mode("append").save()

    def copy():
        s = spark.readStream.format("loom_commits").schema(rows.schema).option("path", source).load()
        q = s.writeStream.format("loom_commits").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    add(0, 100)
    add(100, 250)
    copy()
    assert read(spark, sink, rows.schema).count() == 250
    add(250, 300)
    copy()
    copy()
    assert sorted(r["id"] for r in read(spark, sink, rows.schema).collect()) == list(range(300))
