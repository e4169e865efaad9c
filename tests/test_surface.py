"""What users extend and call: SQL names, families, and models that answer in order."""

import json
import os

import pytest
from pyspark import BarrierTaskContext

from loomspark.functions import sql
from loomspark.operators import inference
from loomspark.plans import catalog_turns, families

SF = "/root/testdata/sf0.001"


def test_sql_names(spark):
    names = sql.register(spark)
    one = lambda q: spark.sql(q).first()[0]
    assert one("SELECT loom_execute('add(1, 2)').value") == 3.0 and one("SELECT loom_execute('foo(').error") is not None
    assert one("SELECT loom_strict_reasons('x + y')") and one(r"SELECT loom_latex_equal('\\frac12', '0.5')") is True
    assert one("""SELECT array_join(loom_flat_texts('[{"key": "a"}, 2]'), '|')""") == "key: a|2"
    assert len(names) == 5


def test_json_objects(spark, tmp_path):
    sql.register(spark)
    texts = ['{"a": 1, "b": "x"} {"a": 2.9}\\n\n[3]', '{"a": "no", "b": {"c": 1}} oops {"a": 5}', "", None, " \\n "]
    spark.createDataFrame(list(enumerate(texts)), "k int, t string").createOrReplaceTempView("files")
    got = [tuple(r) for r in spark.sql("SELECT k, at, a, b FROM files, LATERAL loom_json_objects(t, 'a int, b string') ORDER BY k, at").collect()]
    assert got == [(0, 0, 1, "x"), (0, 1, 2, None), (0, 2, None, None), (1, 0, None, json.dumps({"c": 1})), (1, 1, None, None)]
    assert spark.sql("SELECT * FROM loom_json_objects('{}', 'x double')").schema.simpleString() == "struct<at:bigint,x:double>"
    with pytest.raises(Exception, match="a schema is"):
        spark.sql("SELECT * FROM loom_json_objects('{}', 'x map')").collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_families(spark):
    rows = catalog_turns.turn_rows(spark, SF)
    made = families.items(rows, "turns")
    assert made.count() > 0 and made.where("family <> 'turns' or size(conversations) <> 2").count() == 0
    families.register("short", lambda d: d.select("id"), lambda d: d.withColumnRenamed("id", "record_id"))
    both = families.mixed({"turns": rows, "short": rows})
    assert both.groupBy("family").count().count() == 2 and both.where("family = 'short' and conversations is not null").count() == 0
    with pytest.raises(KeyError, match="not registered"):
        families.items(rows, "unknown")


def test_ordered_answers(spark, tmp_path):
    df = spark.range(0, 500, 1, 7).selectExpr("id", "if(id % 9 = 0, null, concat('text ', id)) AS text").orderBy("text")
    broken = str(tmp_path / "broken")

    def load(rank, ranks):
        context = BarrierTaskContext.get()
        assert ranks == 3 and rank == context.partitionId()
        if rank == 1 and not os.path.exists(broken):  # fails once
            open(broken, "w").close()
            raise RuntimeError("rank 1 is lost")
        return lambda texts: [f"{rank}:{t}" for t in texts]

    got = inference.infer(df, load, "text", "id", ranks=3, batch=8).collect()
    assert os.path.exists(broken) and [r["id"] for r in got] == list(range(500)) and [r["place"] for r in got] == list(range(1, 501))
    assert all(r["response"] == f"{r['id'] % 3}:{r['text']}" for r in got)
    with pytest.raises(Exception, match="answers to"):
        inference.infer(df, lambda rank, ranks: lambda texts: texts[1:], "text", "id", ranks=2).collect()
