"""The registered queries: their SQL where there is one, and the rules of their contracts elsewhere."""

import os
import zlib

import duckdb
import pytest

from loomspark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = db.execute(f"select {', '.join(columns)} from ({queries.ORACLE[name]})").fetchall()
    assert shown(tuple(r) for r in got.select(*columns).collect()) == shown(want)


@pytest.mark.parametrize(("name", "of", "out", "truth"), [("op5_toxicity", 5, 0, "toxic"), ("op6_language_id", 4, 2, "lang")])
def test_held_out(spark, db, name, of, out, truth):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    assert len(rows) == db.execute("select count(*) from documents").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == out) and 0 <= r["score"] <= 1 for r in rows)
    table = "labels" if truth == "toxic" else "documents"
    known = dict(db.execute(f"select doc_id, {truth} from {table} where {truth} is not null").fetchall())
    said = "predicted" if truth == "toxic" else "lang_pred"
    judged = [r[said] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert judged and sum(judged) >= 0.9 * len(judged)
    if truth == "toxic":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
