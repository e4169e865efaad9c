"""Queries on conversations with annotated turns, each with its SQL. ``catalog`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import turns
from .catalog import query, table

#: User turns as records: the last eight are annotated; every fifth annotated answer is a placeholder, some are wrong, and every seventh turn has evidence that isn't in its report.
_TURNS = r"""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w, conv_id % 1000 + 200000 AS p, turn % 3 + 100000 AS q FROM conversations WHERE role = 'user'),
c AS (SELECT *, regexp_replace(regexp_replace(w, '(\d)([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])(\d\d\d\d)\b', '\1 \2', 'g') AS question FROM u),
k AS (SELECT *, trim(regexp_replace(lower(question), '[^a-z0-9%$]+', ' ', 'g')) AS same,
  CASE WHEN length(question) <= 400 THEN question ELSE regexp_replace(substr(question, 1, 397), '\s+$', '') || '...' END AS brief,
  len(string_split(question, ' ')) < 4 OR regexp_matches(question, '\d\d\d\d[A-Za-z]') OR regexp_matches(question, '[A-Za-z]\d\d\d\d\b') AS odd,
  t % 7 <> 3 AS exact, t % 5 = 2 AS wrong, 'Evidence:' || chr(10) || '- it cost ' || p || ' then' || chr(10) || chr(10) || 'Program: subtract(' || p || ', ' || q || ')' || chr(10) || chr(10) || 'Answer: ' || (p - q) AS target FROM c),
r AS (SELECT *, trim(regexp_replace(lower(brief), '[^a-z0-9%$]+', ' ', 'g')) AS short, NOT odd AND exact AND NOT wrong AND same <> '' AS own FROM k),
h AS (SELECT r.conv_id, r.t, x.t AS place, x.brief, x.short, x.short = r.same AS again,
    (SELECT max(a.t) FROM r a WHERE a.conv_id = r.conv_id AND a.t BETWEEN r.t - 7 AND r.t - 1 AND a.same = x.short AND NOT a.odd AND r.exact AND NOT a.wrong) AS here,
    (SELECT max(b.t) FROM r b WHERE b.conv_id = r.conv_id AND b.t < r.t AND b.same = x.short AND b.own) AS prior
  FROM r JOIN r x ON x.conv_id = r.conv_id AND x.t BETWEEN r.t - 6 AND r.t - 1 WHERE x.short <> ''),
f AS (SELECT h.*, coalesce(g.question, h.brief) AS asked, g.target AS target FROM h LEFT JOIN r g ON g.conv_id = h.conv_id AND g.t = coalesce(h.here, h.prior)),
s AS (SELECT conv_id, t, count(*) FILTER (again AND short <> '') AS repeated, count(*) FILTER (NOT again AND target IS NOT NULL) AS full_turns, count(*) FILTER (NOT again AND target IS NULL) AS question_turns,
  string_agg(asked || '=>' || coalesce(target, ''), '|' ORDER BY place) FILTER (NOT again) AS history, string_agg(asked || ' ' || coalesce(target, ''), ' ' ORDER BY place) FILTER (NOT again) AS said,
  list(target) FILTER (NOT again AND target IS NOT NULL) AS targets FROM f GROUP BY conv_id, t),
z AS (SELECT r.*, coalesce(repeated, 0) AS repeated, coalesce(full_turns, 0) AS full_turns, coalesce(question_turns, 0) AS question_turns, coalesce(history, '') AS history, coalesce(said, '') AS said,
  len(list_filter(coalesce(targets, []), lambda x: contains(x, 'Answer: ' || (p - q)))) > 0 AS leaked FROM r LEFT JOIN s USING (conv_id, t))
"""


def turn_rows(spark, d: str) -> DataFrame:
    c = F.col
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", (F.row_number().over(w) - 1).alias("t"))
    u = u.withColumn("p", (c("conv_id") % 1000 + 200000).cast("string")).withColumn("q", (c("turn") % 3 + 100000).cast("string"))
    u = u.withColumn("gap", (c("p").cast("long") - c("q").cast("long")).cast("string"))
    program = F.concat(F.lit("subtract( "), "p", F.lit(" ,"), "q", F.lit(")"))
    answer = F.when(c("t") % 5 == 0, "A0").when(c("t") % 5 == 2, (c("gap").cast("long") + 1_000_000).cast("string")).otherwise(c("gap"))
    last = lambda x: F.collect_list(x).over(w.rowsBetween(-7, 0))
    u = u.select("*", last(c("text")).alias("dial"), last(program).alias("programs"), last(c("gap")).alias("exes"), last(answer).alias("answers"), program.alias("program"))
    cost = F.concat(F.lit("it cost "), "p", F.lit(" then"))
    gold = F.when(c("t") % 7 == 3, "not there at all").otherwise(cost)
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return u.select(
        F.concat("conv_id", F.lit("_"), "t").alias("id"), F.concat(F.lit("talk"), "conv_id").alias("conversation_id"), F.struct("conv_id", "turn").alias("ord"), *text("filename", "question", "program_re", "answer", "exe_ans"), F.lit(None).cast("int").alias("turn_ind"),
        F.array(cost).alias("pre_text"), F.array(F.lit("nothing more")).alias("post_text"), F.array(F.array(F.lit("parts"), c("p"))).alias("table"), F.array(F.struct(F.lit("text_0").alias("raw_id"), gold.alias("text"))).alias("gold"),
        F.struct(*text("question"), c("program").alias("program_re"), *text("answer"), c("gap").alias("exe_ans")).alias("qa"),
        F.struct(
            c("dial").alias("cur_dial"), F.array().cast("array<string>").alias("dialogue_break"), (F.size("dial") - 1).alias("turn_ind"), *text("cur_program", "exe_ans"), c("programs").alias("turn_program"), c("exes").alias("exe_ans_list"), c("answers").alias("answer_list")
        ).alias("annotation"),
    )


@query(_TURNS + """
SELECT conv_id, turn, question, same, CAST(p - q AS VARCHAR) AS answer_norm, md5(history) AS history, repeated, full_turns, question_turns, leaked FROM z""")
def c_turn_history(spark, d):
    s = turns.with_history(turn_rows(spark, d))
    shown = F.array_join(F.transform("history", lambda h: F.concat(h["question"], F.lit("=>"), F.coalesce(h["target"], F.lit("")))), "|")
    return s.select("ord.conv_id", "ord.turn", "question", turns.X.comparable_question(F.col("question")).alias("same"), "answer_norm", F.md5(shown).alias("history"), F.col("repeated_questions").cast("long").alias("repeated"),
        F.col("full_turns").cast("long").alias("full_turns"), F.col("question_turns").cast("long").alias("question_turns"), F.col("answer_in_history").alias("leaked"))


@query(_TURNS + r""", l AS (SELECT *, lower(question) AS low, full_turns + question_turns > 0 AS turned, trim(regexp_replace(lower(said), '[^a-z0-9%$]+', ' ', 'g')) AS before FROM z),
y AS (SELECT *, CASE WHEN turned AND contains(before, 'program subtract ' || p || ' ' || q || ' answer ' || (p - q)) THEN 'current_target_leaked_in_history,' ELSE '' END || CASE WHEN turned AND same <> '' AND contains(before, same) THEN 'duplicate_current_question_in_history,' ELSE '' END
  || CASE WHEN NOT exact THEN 'evidence_not_in_rendered_prompt,non_exact_evidence_alignment,' ELSE '' END || CASE WHEN wrong THEN 'raw_answer_mismatch_with_answer_norm,' ELSE '' END AS flags FROM l)
SELECT conv_id, turn, flags, CASE WHEN leaked THEN 'current_answer_repeated_in_history' ELSE '' END || CASE WHEN leaked AND odd THEN ',' ELSE '' END || CASE WHEN odd THEN 'suspicious_question_text' ELSE '' END AS semantic,
  CASE WHEN regexp_matches(low, 'percentage|percent') THEN CASE WHEN turned THEN 'follow_up_percentage_change' ELSE 'self_contained' END WHEN regexp_matches(low, 'difference|change') THEN CASE WHEN turned THEN 'follow_up_difference' ELSE 'self_contained' END
    WHEN regexp_matches(low, 'what about|how about') THEN 'follow_up_lookup' WHEN regexp_matches(low, 'prior|previous|it|that|those') AND turned THEN 'entity_carryover' ELSE 'self_contained' END AS dependency,
  md5(CASE WHEN question = '' THEN '' ELSE 'You are a financial conversational reasoning assistant.' || chr(10) || chr(10) || 'Use the conversation history and report context to identify supporting evidence, produce the executable program, and give the final answer.' || chr(10) || chr(10)
    || CASE WHEN turned THEN CASE WHEN full_turns > 0 THEN 'Conversation history:' ELSE 'Conversation history questions:' END || chr(10) || (SELECT string_agg(CASE WHEN f.target IS NOT NULL THEN 'Q: ' || f.asked || chr(10) || f.target WHEN y.full_turns > 0 THEN 'Q: ' || f.asked ELSE '- ' || f.asked END, chr(10) || chr(10) ORDER BY f.place)
      FROM f WHERE f.conv_id = y.conv_id AND f.t = y.t AND NOT f.again) || chr(10) || chr(10) ELSE '' END
    || 'Text before table:' || chr(10) || '- it cost ' || p || ' then' || chr(10) || chr(10) || 'Table:' || chr(10) || 'parts | ' || p || chr(10) || chr(10) || 'Text after table:' || chr(10) || '- nothing more' || chr(10) || chr(10) || 'Current question: ' || question || chr(10) || chr(10)
    || 'Respond exactly in this format:' || chr(10) || 'Evidence:' || chr(10) || '- ...' || chr(10) || chr(10) || 'Program: ...' || chr(10) || 'Answer: ...' END) AS prompt FROM y""")
def c_turn_records(spark, d):
    s = turns.turn_records(turn_rows(spark, d))
    flags = F.concat(F.array_join("audit_flags", ","), F.when(F.size("audit_flags") > 0, ",").otherwise(""))
    return s.select("ord.conv_id", "ord.turn", flags.alias("flags"), F.array_join("semantic_audit_flags", ",").alias("semantic"), F.col("history_dependency").alias("dependency"), F.md5("prompt").alias("prompt"))
