"""Records and chunks at the edges that small tables don't have."""

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from loomspark.plans import records

LINES = "select * from (values (4, 2, 900001, 1), (4, 4, 900001, 1), (5, 6, 1000, 100)) t(l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _same(spark, folder, name, tables):
    db = duckdb.connect()
    for t, sql in tables.items():
        db.execute(f"create table {t} as {sql}")
        db.execute(f"copy {t} to '{folder}/{t}.parquet'")
    wanted = db.execute(oracle_sql()[name]).fetchall()
    found = [tuple(r) for r in queries()[name](spark, str(folder)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_a_number_within_a_longer_one_is_no_evidence(spark, tmp_path):
    # 1100001 holds the digits of 100001
    _same(spark, tmp_path, "c_supervision", {"lineitem": LINES})


def test_audit_items_of_long_numbers(spark, tmp_path):
    _same(spark, tmp_path, "c_audit_items", {"lineitem": LINES})


def test_pairs_of_a_record_come_from_one_pass(spark):
    df = spark.createDataFrame([("a", "q", "Program: add(1, 2)\nAnswer: 3", "A"), ("b", "q", "x", "C")], "record_id string, prompt string, target string, quality_tier string")
    both = records.item_pairs(df)
    assert both.select("record_id", "conversations").collect() == records.sft_items(df).collect()
    assert both.drop("conversations").collect() == records.dpo_items(df).collect()


def test_rows_go_to_more_tasks_than_a_file_has_groups(spark):
    from loomspark.plans.catalog import scattered

    rows = scattered(spark.range(1000).coalesce(1), "id", rows=50)
    assert rows.rdd.getNumPartitions() == 20 and rows.select(F.spark_partition_id()).distinct().count() > 10


def test_chunks_strip_what_the_sql_strips(spark, tmp_path):
    texts = "select 1 as doc_id, 'One.' || chr(160) || ' Two. ' || chr(12288) || 'Three!' || chr(28) || chr(9) || ' Four' || chr(133) as text union all select 2, chr(160) union all select 3, null"
    _same(spark, tmp_path, "m_sentence_chunks", {"documents": texts})


def test_two_scores_of_a_pair_are_fused_as_two_tables_are(spark):
    from loomspark.operators import sequences as Q

    t = spark.createDataFrame([(q, v, float((q * 7 + v * 3) % 5)) for q in range(3) for v in range(20)], "q int, v int, s double")
    score = F.col("s")
    two = Q.fuse(t.select("q", "v", score.alias("score")), t.select("q", "v", (-F.col("v")).alias("score")), ["q", "v"])
    one = Q.fuse_columns(t, "q", "v", score, -F.col("v"))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(one.collect()) == sorted(two.collect())


def test_paired_models_grow_in_tasks_not_within_them(spark, tmp_path, monkeypatch):
    from loomspark.plans import catalog

    monkeypatch.setattr(catalog, "ROWS_A_TASK", 20)
    spark.range(200).selectExpr("id as l_orderkey", "1 as l_linenumber", "0.06D as l_discount", "0.01D as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = queries()["j_paired_models"](spark, str(tmp_path))
    assert "hashpartitioning(id" in df._jdf.queryExecution().executedPlan().toString() and ", 20)" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("new_wrong", 200)]


def test_evidence_without_a_number_is_never_cast(spark):
    # a cast of an empty text throws and catches an exception for each row
    from loomspark.plans import scoring

    rows = spark.createDataFrame([(["x"], "text_0"), (["x"], "table_0"), (["x"], "other"), (["x"], "text_99999999999")], "t array<string>, id string")
    gold = F.array(F.struct(F.col("id").alias("raw_id"), F.lit("x").alias("text")))
    made = rows.select("id", scoring.align(gold, records.blocks(F.col("t"), F.col("t")), F.array(F.col("t"))).alias("e"))
    plan = made._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("try_cast(nullif(") == 2 and plan.count("try_cast(") == 2
    assert [(r["e"][0]["evidence_type"], r["e"][0]["source_location"]) for r in made.collect()] == [("text", "pre_text[0]"), ("table", "table[0]"), ("text", "pre_text[0]"), ("text", "pre_text[0]")]


def test_every_vector_is_a_query(spark, tmp_path, monkeypatch):
    from loomspark.operators import sequences as Q

    monkeypatch.setattr(Q, "BLOCK", 7)
    monkeypatch.setattr(Q, "ROWS_A_SIDE", 20)
    monkeypatch.setattr(Q, "QUERIES_A_BATCH", 3)
    _same(spark, tmp_path, "m_fused_ranks", {"embeddings": "select i as vec_id, case when i <> 5 then [sin(i * 3), cos(i), (i % 3)::double]::float[] end as embedding from range(60) t(i)"})
    assert queries()["m_fused_ranks"](spark, str(tmp_path)).select("q").distinct().count() == 60


def test_products_of_blocks_are_those_of_pairs(spark):
    from loomspark.operators import sequences as Q

    odd = [(1, [0.1, 0.2, 0.3]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, 2.0]), (5, []), (6, [-7.0, 1e300, 0.7]), (None, [1.0, 1.0, 1.0]), (7, [float("nan"), 0.0, 1.0]), (8, []), (1, [0.3, 0.1, 9.0])]
    t = spark.createDataFrame(odd, "k int, x array<float>")
    x = t.select(F.col("k").cast("long").alias("q"), F.col("x").cast("array<double>").alias("a"))
    wanted = x.crossJoin(x.select(F.col("q").alias("v"), F.col("a").alias("b"))).where("q <> v").select("q", "v", Q.dot(F.col("a"), F.col("b")).alias("score"))
    made = Q.every_dot(t, "k", "x")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, made.collect())) == sorted(map(repr, wanted.collect()))


def test_first_numbers_are_parsed_without_lambdas(spark):
    # lambdas are interpreted, not compiled
    from loomspark.functions import numbers as N

    texts = [(x, float(y) if y is not None else None) for x, y in [("(1,200)", -1200), ("(0)", 0), ("(-3)", -3), ("$1,234.5 then 7", 1234.5), ("about 12% or 5", 0.12), ("-4.50%", -0.045), ("none", None), ("", None), (None, None), ("(5%)", -0.05)]]
    made = spark.createDataFrame(texts, "t string, y double").select("y", N.parse_first(F.col("t")).alias("n"))
    assert "lambda" not in made._jdf.queryExecution().analyzed().toString().lower()
    assert all(r["y"] == r["n"] for r in made.collect())
