"""Operators on small tables written out here."""

import time

import pytest
from pyspark.sql import functions as F

from loomspark.operators import gates, groups, relations, sampling, sequences
from loomspark.sources import readers, writers
from loomspark.streaming import events


def test_sequential_dedupe_is_the_ordered_pass(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "a", "z"), (5, "c", "y"), (6, "c", "w")]
    df = spark.createDataFrame(rows, "ord int, key string, prompt string")
    keys, prompts, kept = set(), set(), []
    for o, k, p in rows:
        if k not in keys and p not in prompts:
            keys.add(k), prompts.add(p), kept.append(o)
    assert sorted(r["ord"] for r in relations.sequential_dedupe(df, "key", "prompt", "ord").collect()) == kept


def test_pack_keeps_every_token_of_whole_blocks(spark):
    df = spark.createDataFrame([(1, "g", [1, 2, 3]), (2, "g", [4, 5, 6, 7, 8])], "o int, g string, t array<int>")
    got = {r["block"]: r["tokens"] for r in sequences.pack(df, "t", "o", "g", 5).collect()}
    assert got == {0: [1, 2, 3, 0, 4], 1: [5, 6, 7, 8, 0]}


def test_split_and_quotas(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") < 70, "a").otherwise("b"))
    s = sampling.split(df, 0.1, 1, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 90, "valid": 10}
    got = sampling.stratified(df, ["s"], 11, 1, "id").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 8, "b": 3}
    assert sampling.cycle(df.limit(3), 7, 1, "id").count() == 7


def test_early_stop_in_batch_and_stream(spark, tmp_path):
    schema = "run string, step long, reward_std double, zero_std boolean, executable_rate double, marker_rate double, multiple_program_rate double, all_wrong boolean, loss double"
    row = lambda run, i, **k: (run, i, *({"std": 1.0, "zero": False, "ex": 1.0, "mark": 0.0, "multi": 0.0, "wrong": False, "loss": 1.0} | k).values())
    rows = [row("std", i, std=0.0 if i > 3 else 1.0) for i in range(1, 10)] + [row("zero", i, zero=i > 2) for i in range(1, 12)] + [row("ex", i, ex=0.5) for i in range(1, 11)]
    rows += [row("mark", i, mark=float(i == 2)) for i in range(1, 4)] + [row("multi", i, multi=1.0) for i in range(1, 5)] + [row("wrong", i, wrong=True, multi=1.0) for i in range(1, 6)] + [row("nan", 1, loss=float("nan"))]
    df = spark.createDataFrame(rows, schema)
    got = {(r["run"], r["step"]): r["stop"] for r in groups.early_stop(df, "run", "step").collect()}
    v, c, u = groups.VARIANCE, groups.CONTRACT, groups.UNSTABLE
    assert [got["std", i] for i in range(1, 10)] == [None] * 7 + [v] * 2
    assert got["zero", 9] is None and got["zero", 10] == got["zero", 11] == v and got["ex", 9] is None and got["ex", 10] == c
    assert [got["mark", i] for i in range(1, 4)] == [None, c, c] and [got["multi", i] for i in range(1, 5)] == [None, None, c, c]
    assert [got["wrong", i] for i in range(1, 6)] == [None, None, c, c, v] and got["nan", 1] == u
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.stop_rules(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("stops").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["run"], r["step"]): r["stop"] for r in spark.table("stops").collect()} == got


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: events.source(spark, str(tmp_path / "in"), rows.schema)
    for name, made in {"counted": events.counts(src()), "session": events.sessions(src()), "unique": events.distinct(src(), ["event_id"])}.items():
        q = made.writeStream.format("memory").queryName(name).outputMode("append" if name == "unique" else "complete" if name == "counted" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("rows")).first()[0] == rows.count() == spark.table("unique").count()
    assert spark.table("session").agg(F.sum("rows")).first()[0] <= rows.count()
    for _ in range(2):
        events.append_new(rows, str(tmp_path / "out"), ["event_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.select("event_id").distinct().count()


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    got = readers.read_tolerant(spark, str(tmp_path / "a.jsonl"), "id int")
    assert sorted(str(r["reason"]) for r in got.collect()) == ["None", "None", "drop_bad_json", "skip_blank_line"]
    (tmp_path / "b.json").write_text('{"a": 1}\\n{"a": 2} {"a": 3}')
    assert readers.read_objects(spark, str(tmp_path / "b.json")).count() == 3
    assert [r["line_no"] for r in readers.read_numbered(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()] == [1, 3, 4]
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    assert writers.flat(df).first()["tags"] == "a;b"
    (tmp_path / "c.jsonl").write_text('{"conversations": [{"from": "human", "value": "a"}]}\n\nx\n{"conversations": [{"from": "cat", "value": "a"}]}\n')
    assert readers.validate_lines(spark.read.text(str(tmp_path / "c.jsonl"))).first().asDict() == {"lines": 4, "blank": 1, "bad_json": 1, "bad_turns": 1, "valid": 1}
    assert sorted(r["id"] for r in readers.allowlist(spark.createDataFrame([("a",), ('{"id": "b"}',), ("",)], "value string")).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="no id"):
        readers.allowlist(spark.createDataFrame([("",)], "value string"))


def test_long_texts_are_cut_once(spark):
    """N-grams of a text of 20,000 words take no more than a few seconds."""
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20_000)))], "id int, text string")
    began = time.perf_counter()
    assert relations.overlaps(df, df, 8).first()["shared"] == 19_993
    assert time.perf_counter() - began < 20


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, config string")
    assert gates.require_same(df.where("config = 'a'"), "config").count() == 2
    with pytest.raises(Exception, match="configurations differ"):
        gates.require_same(df, "config").collect()
    assert gates.bucket_rows(df, {"x": (F.col("config") == "a", 1)}, 1, "id").count() == 1
    with pytest.raises(Exception, match="fewer than 3"):
        gates.bucket_rows(df, {"x": (F.col("config") == "a", 3)}, 1, "id").collect()


def test_places_and_pairs(spark):
    left, right = spark.range(0, 1000, 3).withColumn("v", F.col("id") * 2), spark.range(500).withColumnRenamed("id", "k")
    got = relations.zip_rows(left, right, "id", "k").collect()
    assert len(got) == 334 and all(r["id"] == 3 * (r["place"] - 1) and r["k"] == r["place"] - 1 for r in got)


def test_bm25_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The cat sat"), (2, "a cat, a dog; a cat"), (2, "dog"), (3, ""), (4, None), (5, "bird")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "cat dog"), (8, "THE bird bird"), (9, None)], "item_id int, text string")
    rows = lambda: sorted((r["item_id"], r["doc_id"], round(r["score"], 9)) for r in sequences.bm25(docs, queries).collect())
    few = rows()
    monkeypatch.setattr(sequences, "BROADCAST_TERMS", 0)
    assert rows() == few and [r[:2] for r in few] == [(7, 1), (7, 2), (8, 1), (8, 5)]


def test_bm25_deals_documents_to_more_tasks_the_more_pairs_they_make(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "cat dog" if k % 2 else "") for k in range(120)] + [(1, "dog"), (None, "cat cat")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "cat dog"), (8, "dog")], "item_id int, text string")
    rows = lambda: sorted((r["item_id"], r["doc_id"] or -1, round(r["score"], 9)) for r in sequences.bm25(docs, queries).collect())
    few = rows()
    monkeypatch.setattr(sequences, "PAIRS_A_TASK", 20)
    many = sequences.bm25(docs, queries).groupBy(F.spark_partition_id()).count().collect()
    assert rows() == few and len(few) == 121 and len(many) > 8 and max(r["count"] for r in many) <= 40
    assert few[0][:2] == (7, -1) and few[1][2] != few[2][2]


def test_pack_moves_tokens_as_text(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], [f"w{k}.{i}" for i in range(k % 7)]) for k in range(60)] + [(99, "c", ["", "x"]), (100, "c", None)], "k int, g string, t array<string>")
    packed = lambda **more: sorted((r["g"], r["block"], r["tokens"]) for r in sequences.pack(df, "t", "k", "g", 5, "$", **more).collect())
    assert packed(sep=".") != packed() == packed(sep=" ") and packed()
