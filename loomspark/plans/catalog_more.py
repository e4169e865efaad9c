"""Queries on retrieval, packing, quotas, files and streams, each with its SQL where SQL can express it. ``catalog`` registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex
from ..functions import rewards as W
from ..operators import relations, retrieval, sampling
from ..operators import sequences as Q
from .catalog import ORACLE, query, table


_BEST = """
SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({}) AS s) AS r WHERE rank <= 10"""


@query(_BEST.format(ORACLE["m_bm25"].replace(", 6) AS score", ", 9) AS score")))
def m_top_bm25(spark, d):
    return retrieval.top_bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 10).withColumn("score", F.round("score", 6))


@query("""
WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, round(list_dot_product(x, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def m_top_dense(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.top_dense(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), 10)


@query("""
WITH t AS (SELECT doc_id, doc_id % 97 + 2 AS p, n_chars % 89 + 2 AS q, doc_id % 10 AS k FROM documents)
SELECT doc_id, p, q, CAST(CASE WHEN k IN (1, 7) THEN p = q WHEN k IN (5, 9) THEN false ELSE true END AS DOUBLE) AS reward FROM t""")
def d_latex_equality(spark, d):
    """Answers made of two numbers of each document in ten pairs of forms."""
    t = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97 + 2).alias("p"), (F.col("n_chars") % 89 + 2).alias("q"), (F.col("doc_id") % 10).alias("k"))
    made = [
        (r"\frac{%1$d}{%2$d}", r"\dfrac{%3$d}{%4$d}"), (r"\frac{%1$d}{%2$d}", r"\frac{%2$d}{%1$d}"), (r"\sqrt{%5$d}", r"%1$d\sqrt{%2$d}"), (r"x^2 + %1$dx + %2$d", r"%2$d + x\left(x + %1$d\right)"), (r"\{%1$d, %2$d\}", r"\{%2$d, %1$d\}"),
        ("[%1$d, %2$d)", "[%1$d, %2$d]"), ("%1$d.5", r"\frac{%6$d}{2}"), ("(%1$d, %2$d)", "(%2$d, %1$d)"), (r"%1$d\%%", r"\frac{%1$d}{100}"), ("x = %1$d", "%1$d.001"),
    ]
    p, q = F.col("p"), F.col("q")
    form = lambda side: F.element_at(F.array(*(F.format_string(f[side], p, q, 3 * p, 3 * q, p * p * q, 2 * p + 1) for f in made)), (F.col("k") + 1).cast("int"))
    t = t.select("doc_id", "p", "q", F.concat(F.lit(r"Thus \boxed{"), form(0), F.lit("}.")).alias("said"), F.concat(F.lit("So it is #### "), form(1)).alias("gold"))
    return latex.latex_reward(t, "said", "gold").select("doc_id", "p", "q", "reward")


@query(r"""
WITH w AS (SELECT source, doc_id, list_append(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []), '</s>') AS t FROM documents), u AS (SELECT source, doc_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM w),
p AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM u)
SELECT source, CAST(pos // 512 AS BIGINT) AS block, count(*) AS n, md5(string_agg(token, ' ' ORDER BY pos)) AS tokens FROM p WHERE (pos // 512 + 1) * 512 <= total OR total < 512 GROUP BY source, pos // 512""")
def m_packed_tokens(spark, d):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    packed = Q.pack(table(spark, d, "documents").select("doc_id", "source", words.alias("tokens")), "tokens", "doc_id", "source", 512, "</s>", sep=" ")
    return packed.select("source", "block", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') || n_chars % 50 AS k, coalesce(lang, '') || doc_id % 97 AS p, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
s(i, ks, ps, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT) UNION ALL
  SELECT t.i, CASE WHEN ok THEN list_append(ks, k) ELSE ks END, CASE WHEN ok THEN list_append(ps, p) ELSE ps END, CASE WHEN ok THEN doc_id END FROM (SELECT s.ks, s.ps, t.*, NOT list_contains(s.ks, t.k) AND NOT list_contains(s.ps, t.p) AS ok FROM s JOIN t ON t.i = s.i + 1) AS t)
SELECT kept AS doc_id FROM s WHERE kept IS NOT NULL""")
def u_sequential_dedupe(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.col("n_chars") % 50).alias("k"), F.concat(F.coalesce("lang", F.lit("")), F.col("doc_id") % 97).alias("p"))
    return relations.sequential_dedupe(t, "k", "p", "doc_id").select("doc_id")


@query("""
WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('11:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT doc_id, source, lang, k <= n // 2 AS half FROM r""")
def w_half_of_each(spark, d):
    """The half of every source and language that comes first by hash, and the other rows."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang")
    wanted = t.groupBy("source", "lang").agg(F.floor(F.count("*") / 2).alias("quota"))
    return sampling.mark_lowest(t, ["source", "lang"], wanted, sampling.order_key(11, F.col("doc_id")), ["doc_id"], "half")


#: Parts of a reward from the bits of a number of each document, and the modes that are compared.
_PARTS = """
WITH x AS (SELECT doc_id, CAST('0x' || substr(md5(doc_id || ':' || n_chars), 1, 8) AS BIGINT) AS h FROM documents),
p AS (SELECT doc_id, (h % 8 > 0)::INT AS runs, (h // 8 % 2)::DOUBLE AS exact, (h // 16 % 4 > 0)::INT AS dsl, (h // 64 % 4 > 0)::INT AS answered, (h // 64 % 4 > 1)::INT::DOUBLE AS consistent, (h // 256 % 2)::DOUBLE AS answer, (h // 512 % 4 = 0)::INT AS forbidden, (h // 2048 % 4 = 0)::INT AS multiple,
  (h // 8192 % 2)::INT AS behind, (h // 16384 % 3 = 0)::INT AS infix, (h // 65536 % 4 = 0)::INT AS wrapper, (h // 262144 % 3)::INT AS schemas, (h // 1048576 % 5)::INT AS contracts, (h % 11)::DOUBLE / 10 AS likeness, (h % 7)::DOUBLE / 10 AS share, (h % 13)::DOUBLE / 100 AS long, (h % 3 > 0)::INT AS due FROM x),
q AS (SELECT *, least(CAST(0.15 AS DOUBLE), CAST(0.05 AS DOUBLE) * schemas) + least(CAST(0.15 AS DOUBLE), CAST(0.05 AS DOUBLE) * contracts) AS soft, CAST(0.05 AS DOUBLE) * (forbidden + multiple + behind) AS plain, 1 + CAST(0.05 AS DOUBLE) * likeness + CAST(0.03 AS DOUBLE) * share + CAST(0.02 AS DOUBLE) * likeness + CAST(0.02 AS DOUBLE) * share AS base,
  schemas + contracts > 0 AS violated, answered = 1 AND consistent = 0 AS clash FROM p),
r AS (SELECT *, CAST(0.85 AS DOUBLE) AS floor, CAST(0.2 AS DOUBLE) AS cap, CAST(0.12 AS DOUBLE) * share AS made, least(likeness, 1) AS scale FROM q),
d AS (SELECT *, soft + CAST(0.04 AS DOUBLE) * behind + CAST(0.06 AS DOUBLE) * infix + CAST(0.06 AS DOUBLE) * wrapper + CAST(0.04 AS DOUBLE) * (1 - scale) AS dense FROM r)
"""


@query(_PARTS + """
SELECT doc_id, answer AS answer_only, round(CASE WHEN answer > 0 THEN greatest(CAST(0.55 AS DOUBLE), 1 + CAST(0.15 AS DOUBLE) * exact + CAST(0.05 AS DOUBLE) * consistent - soft - CASE WHEN dsl = 1 THEN 0 ELSE 0.12 END::DOUBLE - long) ELSE 0 END, 9) AS answer_first,
  CASE WHEN runs = 0 THEN -1 WHEN exact = 1 THEN CASE WHEN violated OR dsl = 0 THEN 0.25 ELSE 1 END WHEN violated OR dsl = 0 THEN -0.3 ELSE -0.1 END::DOUBLE AS calibration,
  round(CASE WHEN runs = 0 THEN -1 WHEN exact = 1 THEN greatest(floor, base - plain - long) ELSE least(cap, greatest(0, cap * likeness - plain - long)) END, 9) AS execution,
  round(CASE WHEN runs = 0 OR violated THEN -1 WHEN exact = 1 THEN greatest(floor, base + made - plain - long) ELSE least(cap, greatest(0, cap * likeness - made - CAST(0.3 AS DOUBLE) * (1 - share) - plain - long)) END, 9) AS gate_and_process,
  round(CASE WHEN runs = 0 THEN -0.5 WHEN exact = 1 THEN least(greatest(floor, 1 + CAST(0.03 AS DOUBLE) * likeness + CAST(0.02 AS DOUBLE) * share + CAST(0.01 AS DOUBLE) * likeness + CAST(0.02 AS DOUBLE) * share - soft - long), CASE WHEN due = 1 AND share < 1 THEN 1 - CAST(0.4 AS DOUBLE) * (1 - share) ELSE 9 END)
    ELSE least(cap, greatest(0, cap * likeness - soft - long)) END, 9) AS outcome_first,
  round(CASE WHEN runs = 0 THEN -1 WHEN exact = 1 THEN CASE WHEN infix + behind + wrapper > 0 THEN least(greatest(floor, base - dense - long), 1 - least(CAST(0.35 AS DOUBLE), greatest(CAST(0.02 AS DOUBLE), dense))) ELSE greatest(floor, base - dense - long) END ELSE least(cap, greatest(0, cap * likeness - dense - long)) END, 9) AS dense,
  round(CASE WHEN runs = 0 THEN -1 WHEN exact = 1 THEN greatest(floor, base + CAST(0.06 AS DOUBLE) * answer + CAST(0.04 AS DOUBLE) * consistent - CASE WHEN answered = 0 THEN 0.05 WHEN clash THEN 0.15 ELSE 0 END::DOUBLE - plain - long) ELSE least(cap, greatest(0, cap * likeness + CAST(0.01 AS DOUBLE) * answer - plain - long)) END, 9) AS first_aux,
  round(CASE WHEN runs = 0 THEN -1 WHEN exact = 1 THEN CASE WHEN clash THEN least(CAST(0.25 AS DOUBLE), greatest(floor, CAST(0.25 AS DOUBLE) - plain - long)) WHEN answered = 0 THEN greatest(floor, base - CAST(0.04 AS DOUBLE) - plain - long) ELSE greatest(floor, base + CAST(0.03 AS DOUBLE) * answer + CAST(0.05 AS DOUBLE) * consistent - plain - long) END
    ELSE least(cap, greatest(0, cap * likeness - plain - long)) END, 9) AS gated FROM d""")
def d_program_rewards(spark, d):
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "n_chars")), 1, 8), 16, 10).cast("long").alias("h")
    t = table(spark, d, "documents").select("doc_id", h)
    b = lambda by, m: F.floor(F.col("h") / by) % m
    likeness, share, long_ = b(1, 11) / F.lit(10.0), b(1, 7) / F.lit(10.0), b(1, 13) / F.lit(100.0)
    parts = {
        "runs": b(1, 8) > 0, "exact": b(8, 2), "dsl": b(16, 4) > 0, "answered": b(64, 4) > 0, "consistent": b(64, 4) > 1, "answer_only": b(256, 2), "answer_first": b(256, 2), "answer_line": b(64, 4) > 0, "forbidden": b(512, 4) == 0,
        "multiple": b(2048, 4) == 0, "trailing": b(8192, 2), "infix": b(16384, 3) == 0, "wrapper": b(65536, 4) == 0, "schema_reasons": b(262144, 3), "contract_reasons": b(1048576, 5), "structure": likeness, "coverage": share, "steps": likeness,
        "closeness": likeness, "semantic": share, "process": share, "scale": likeness, "brevity": share, "history": share, "length_penalty": long_, "history_due": b(1, 3) > 0,
    }
    S = W.RewardSettings
    settings = {
        "answer_only": S("answer_only"), "answer_first": S("answer_first"), "calibration": S("frontier_execution_calibration"), "execution": S(), "gate_and_process": S(hard_gate=True, process=True, semantic_weight=0.3),
        "outcome_first": S(outcome_first=True, invalid=-0.5, history_weight=0.4), "dense": S(dense=True), "first_aux": S("program_first_answer_aux"), "gated": S("program_gated_answer_aux"),
    }
    free = {n: (parts if n == "outcome_first" else {k: v for k, v in parts.items() if k != "history_due"}) for n in settings}
    return t.select("doc_id", *(F.round(W.program_reward(free[n], s), 9).alias(n) for n, s in settings.items()))
