"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import numbers as N
from ..functions import program as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import conversations as V
from ..operators import groups as G
from ..operators import relations as R
from ..operators import sampling as L
from ..operators import sequences as Q
from . import scoring

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows a task where every row takes much work or much state.
ROWS_A_TASK = 500_000


def scattered(df: DataFrame, *keys: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` by a hash of ``keys`` over all cores, and over more tasks the more rows it has, so that no task grows with the table. Files of few row
    groups are read by few tasks however many splits they have. Rows are counted first, of which Parquet reads only the footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


def filled(template: str, *names: str) -> Column:
    """A template whose ``%d`` are columns of whole numbers; null if one of them is. A formatter takes several times as long as a concatenation."""
    texts = template.split("%d")
    return F.concat(F.lit(texts[0]), *(x for n, text in zip(names, texts[1:], strict=True) for x in (F.col(n).cast("string"), F.lit(text))))


# Text (of P1-P44)


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ws, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS lowered,
  CASE WHEN length(trim(text, E' \t\n\r')) <= 60 THEN trim(text, E' \t\n\r') ELSE regexp_replace(substr(trim(text, E' \t\n\r'), 1, 57), '\s+$', '') || '...' END AS cut,
  trim(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^a-z0-9.]+', ' ', 'g')) AS audit,
  trim(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^a-z0-9%$]+', ' ', 'g')) AS question,
  lower(regexp_replace(text, '\s+', '', 'g')) AS squeezed, md5(text) AS md5, sha256(text) AS sha256
FROM documents""")
def p_text_normalization(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.normalize_ws(t).alias("ws"), F.lower(X.normalize_ws(t)).alias("lowered"), X.truncate(t, 60).alias("cut"), X.audit_text(t).alias("audit"),
        X.comparable_question(t).alias("question"), F.lower(F.regexp_replace(t, r"(?U)\s+", "")).alias("squeezed"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256")
    )


@query(r"""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'what was the change in ' || (1990 + l_linenumber) || 'sales from' || (2000 + l_linenumber) || ' to x' AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  regexp_replace(regexp_replace(q, '(\d)([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])(\d\d\d\d)\b', '\1 \2', 'g') AS cleaned,
  regexp_matches(q, '\d\d\d\d[A-Za-z]') OR regexp_matches(q, '[A-Za-z]\d\d\d\d\b') AS suspicious
FROM q""")
def p_question_repair(spark, d):
    q = F.concat(F.lit("what was the change in "), (F.col("l_linenumber") + 1990).cast("string"), F.lit("sales from"), (F.col("l_linenumber") + 2000).cast("string"), F.lit(" to x"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.clean_question(q).alias("cleaned"), X.suspicious_question(q).alias("suspicious"))


@query(r"""
WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey % 4 AS k FROM orders),
s AS (SELECT o_orderkey, CASE k WHEN 0 THEN '(' || n || ')' WHEN 1 THEN '$' || n || ' then 7' WHEN 2 THEN 'about ' || n || '% or 5' ELSE 'none' END AS s, k, n FROM t)
SELECT o_orderkey, s, CAST(CASE k WHEN 0 THEN CASE WHEN n > 0 THEN -n ELSE n END WHEN 1 THEN n WHEN 2 THEN n / CAST(100.0 AS DOUBLE) END AS DOUBLE) AS first_number,
  CAST(CASE k WHEN 0 THEN n WHEN 1 THEN 7 WHEN 2 THEN 5 END AS DOUBLE) AS last_number, CAST(CASE k WHEN 3 THEN NULL ELSE n END AS DOUBLE) AS plain
FROM s""")
def p_number_parsers(spark, d):
    n, k = F.floor("o_totalprice").cast("string"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.concat(F.lit("("), n, F.lit(")"))).when(k == 1, F.concat(F.lit("$"), n, F.lit(" then 7"))).when(k == 2, F.concat(F.lit("about "), n, F.lit("% or 5"))).otherwise("none")
    t = table(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return t.select("*", N.parse_first(F.col("s")).alias("first_number"), N.parse_distilled(F.col("s")).alias("last_number"), N.parse_plain(F.col("s")).alias("plain"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  abs(a - b) <= greatest(1e-4, abs(b) * 1e-4) AS equivalent,
  abs(a - b) <= greatest(0.01 * greatest(abs(a), abs(b)), 0.5) AS near,
  (abs(a - b) <= greatest(1e-4, abs(b) * 1e-4) OR abs(a * 100 - b) <= greatest(1e-4, abs(b) * 1e-4) OR abs(a - b * 100) <= greatest(1e-4, abs(b * 100) * 1e-4)
   OR (abs(a - b) <= 1 AND (abs(a) > 1 OR abs(b) > 1)) OR (abs(a * 100 - b) <= 1 AND (abs(a * 100) > 1 OR abs(b) > 1)) OR (abs(a - b * 100) <= 1 AND (abs(a) > 1 OR abs(b * 100) > 1))) AS percent
FROM (SELECT *, l_discount * CAST(100 AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b FROM lineitem)""")
def p_tolerances(spark, d):
    a, b = F.col("l_discount") * F.lit(100.0), F.col("l_linenumber").cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.equivalent(a, b).alias("equivalent"), N.close(a, b, 0.01, 0.5).alias("near"), N.equivalent(a, b, F.lit(True)).alias("percent")
    )


@query(r"""
SELECT conv_id, turn, '<think> ' || left(text, 10) || '</think><answer>' || left(text, 5) || '</answer>' AS tagged,
  trim(left(text, 10), E' \n') AS think, trim(left(text, 5), E' \n') AS answer, '[' || turn || E']' AS label,
  CASE WHEN contains(text, '. ') THEN substr(text, 1, strpos(text, '. ') - 1) ELSE text END AS before_stop
FROM conversations""")
def p_tags_and_stops(spark, d):
    t = table(spark, d, "conversations")
    tagged = F.concat(F.lit("<think> "), F.left("text", F.lit(10)), F.lit("</think><answer>"), F.left("text", F.lit(5)), F.lit("</answer>"))
    t = t.select("conv_id", "turn", "text", tagged.alias("tagged"))
    return t.select("conv_id", "turn", "tagged", X.tag(F.col("tagged"), "think").alias("think"), X.tag(F.col("tagged"), "answer").alias("answer"), F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")).alias("label"), X.cut_at_stops(F.col("text"), [". "]).alias("before_stop"))


# Programs (of D1-D16), over a program made of each line item

_PROGRAMS = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 6 AS k FROM lineitem)
"""


def programs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_linenumber") % 6).alias("k"))
    t, f = scattered(t, "l_orderkey", "l_linenumber"), filled
    program = (
        F.when(F.col("k") == 0, f("divide(subtract(%d, %d), %d)", "p", "q", "q"))
        .when(F.col("k") == 1, f("subtract( %d ,%d), divide(#0, const_%d)", "p", "q", "q"))
        .when(F.col("k") == 2, f("table_average(%d, %d, %d)", "p", "q", "s"))
        .when(F.col("k") == 3, f("%d - %d", "p", "q"))
        .when(F.col("k") == 4, f("divide(%d, subtract(%d, %d))", "p", "q", "q"))
        .otherwise(f("max(%d, multiply(%d, 2))", "p", "q"))
    )
    return X.computed(t, program=program)


@query(_PROGRAMS + """
SELECT l_orderkey, l_linenumber, p, s,
  CASE k WHEN 0 THEN (p - q) / CAST(q AS DOUBLE) WHEN 1 THEN (p - q) / CAST(q AS DOUBLE) WHEN 2 THEN (p + q + s) / CAST(3 AS DOUBLE) WHEN 5 THEN CAST(greatest(p, q * 2) AS DOUBLE) END AS value,
  CASE k WHEN 3 THEN 'program_strict_validation_error' WHEN 4 THEN 'program_parse_or_execute_error' END AS error,
  CASE k WHEN 0 THEN 'divide(subtract(' || p || ', ' || q || '), ' || q || ')' WHEN 1 THEN 'subtract(' || p || ', ' || q || '), divide(#0, ' || q || ')'
    WHEN 2 THEN 'table_average(' || p || ', ' || q || ', ' || s || ')' WHEN 3 THEN p || ' - ' || q
    WHEN 4 THEN 'divide(' || p || ', subtract(' || q || ', ' || q || '))' ELSE 'max(' || p || ', multiply(' || q || ', 2))' END AS canonical,
  CASE k WHEN 3 THEN 'subtract(' || p || ', ' || q || ')' END AS relaxed
FROM t""")
def d_execute_program(spark, d):
    t = programs(spark, d).withColumn("canonical", P.canonicalize(F.col("program"))).withColumn("r", P.execute("canonical"))
    relaxed = F.when(F.col("k") == 3, P.relaxed_canonicalize(F.col("program")))
    return t.select("l_orderkey", "l_linenumber", "p", "s", "r.value", F.substring_index("r.error", ":", 1).alias("error"), "canonical", relaxed.alias("relaxed"))


@query(_PROGRAMS + """
SELECT l_orderkey, l_linenumber, p, s, CASE k WHEN 0 THEN (p - q) / CAST(q AS DOUBLE) WHEN 2 THEN (p + q + s) / CAST(3 AS DOUBLE) WHEN 5 THEN CAST(greatest(p, q * 2) AS DOUBLE) END AS value
FROM t WHERE k IN (0, 2, 4, 5)""")
def d_execute_native(spark, d):
    t = programs(spark, d).where(F.col("k").isin(0, 2, 4, 5))
    return t.select("l_orderkey", "l_linenumber", "p", "s", P.execute_native(F.col("program"), 3).alias("value"))


@query(_PROGRAMS + """
SELECT l_orderkey, l_linenumber, p, s, CASE k WHEN 0 THEN 'relative_change' WHEN 1 THEN 'relative_change' WHEN 2 THEN 'aggregate' WHEN 3 THEN 'lookup' WHEN 4 THEN 'relative_change' ELSE 'aggregate' END AS family,
  CASE k WHEN 0 THEN 'divide,subtract' WHEN 1 THEN 'subtract,divide' WHEN 2 THEN 'table_average' WHEN 3 THEN '' WHEN 4 THEN 'divide,subtract' ELSE 'max,multiply' END AS ops,
  CASE k WHEN 0 THEN 'divide(subtract(NUM, NUM), NUM)' WHEN 1 THEN 'subtract(NUM, NUM), divide(REF, NUM)' WHEN 2 THEN 'table_average(NUM, NUM, NUM)' WHEN 3 THEN 'NUM - NUM' WHEN 4 THEN 'divide(NUM, subtract(NUM, NUM))' ELSE 'max(NUM, multiply(NUM, NUM))' END AS skeleton,
  CASE k WHEN 2 THEN 'other' WHEN 3 THEN 'direct_lookup' WHEN 5 THEN 'other' ELSE 'share_of_total' END AS kind
FROM t""")
def d_program_analysis(spark, d):
    p = F.col("program")
    return programs(spark, d).select("l_orderkey", "l_linenumber", "p", "s", P.family(p).alias("family"), F.array_join(P.ops(p), ",").alias("ops"), P.skeleton(p).alias("skeleton"), C.question_type(F.lit("what percent of sales"), p).alias("kind"))


@query(_PROGRAMS.rstrip() + r""",
g AS (SELECT *, 'divide(subtract(' || p || ', ' || q || '), ' || q || ')' AS gold, CASE k WHEN 0 THEN 'divide(subtract(' || p || ', ' || q || '), ' || q || ')' WHEN 1 THEN 'subtract( ' || p || ' ,' || q || '), divide(#0, const_' || q || ')' WHEN 2 THEN 'table_average(' || p || ', ' || q || ', ' || s || ')'
  WHEN 3 THEN p || ' - ' || q WHEN 4 THEN 'divide(' || p || ', subtract(' || q || ', ' || q || '))' ELSE 'max(' || p || ', multiply(' || q || ', 2))' END AS program FROM t),
a AS (SELECT *, regexp_extract_all(program, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS o, regexp_extract_all(gold, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS og, regexp_extract_all(program, '\d+') AS n, regexp_extract_all(gold, '\d+') AS ng FROM g),
b AS (SELECT *, len(o) AS x, len(og) AS y, CAST(coalesce(list_sum(list_transform(list_distinct(o), lambda e: least(len(list_filter(o, lambda f: f = e)), len(list_filter(og, lambda f: f = e))))), 0) AS DOUBLE) AS common_o,
  CAST(coalesce(list_sum(list_transform(list_distinct(n), lambda e: least(len(list_filter(n, lambda f: f = e)), len(list_filter(ng, lambda f: f = e))))), 0) AS DOUBLE) AS common_n,
  CASE WHEN coalesce(o[1], '') <> og[1] THEN 0 WHEN coalesce(o[2], '') <> og[2] THEN 1 ELSE 2 END AS prefix FROM a)
SELECT l_orderkey, l_linenumber, p, s, round(CAST(0.45 AS DOUBLE) * 2 * common_o / (x + y) + CAST(0.25 AS DOUBLE) * 2 * common_n / (len(n) + len(ng)) + CAST(0.2 AS DOUBLE) * prefix / greatest(x, y) + CAST(0.1 AS DOUBLE) * least(x, y) / greatest(x, y), 9) AS similarity,
  len(list_intersect(list_distinct(n), list_distinct(ng))) / CAST(len(list_distinct(n)) AS DOUBLE) AS grounding, CASE WHEN k = 3 THEN 'infix' ELSE '' END AS lint,
  CASE k WHEN 2 THEN program || ' with a nearby unsupported value' WHEN 3 THEN program || ' with a nearby unsupported value' WHEN 5 THEN replace(program, 'multiply', 'divide') ELSE replace(program, 'divide', 'multiply') END AS mutated FROM b""")
def d_program_similarity(spark, d):
    p, c = F.col("program"), F.col
    t = X.computed(programs(spark, d), gold=filled("divide(subtract(%d, %d), %d)", "p", "q", "q"))
    t = X.computed(t, a=P.ops(p), b=P.ops(c("gold")), x=P.arguments(p), y=P.arguments(c("gold")))
    return t.select(
        "l_orderkey", "l_linenumber", "p", "s", F.round(P.similarity_of(c("a"), c("b"), c("x"), c("y")), 9).alias("similarity"), P.grounding_of(c("x"), c("y")).alias("grounding"), F.array_join(P.lint(p), ",").alias("lint"), P.mutate(p).alias("mutated")
    )


# Conversations (F1, F5, F6, C21-C24, W2)

_FOLD = """
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS who, trim(text, E' \\t\\n\\r') AS v,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
b AS (SELECT *, CASE WHEN who NOT IN ('human', 'gpt') OR v = '' THEN 'drop_invalid_turn' WHEN who <> CASE WHEN i % 2 = 0 THEN 'human' ELSE 'gpt' END THEN 'drop_role_order' WHEN length(v) > 2000 THEN 'drop_overlong_turn' END AS bad FROM t),
c AS (SELECT conv_id, count(*) AS turns, sum(length(v)) AS chars, arg_min(bad, i) FILTER (bad IS NOT NULL) AS bad FROM b GROUP BY conv_id),
r AS (SELECT conv_id, turns, chars, CASE WHEN bad IS NOT NULL THEN bad WHEN turns < 2 THEN 'drop_too_few_turns' WHEN turns % 2 <> 0 THEN 'drop_odd_turns' WHEN turns > 20 THEN 'drop_too_many_turns' WHEN chars > 4000 THEN 'drop_overlong_sample' END AS reason FROM c)
"""


def folded(spark: SparkSession, d: str) -> DataFrame:
    return V.fold(table(spark, d, "conversations"))


@query(_FOLD + "SELECT conv_id, turns, CAST(chars AS BIGINT) AS chars, reason FROM r")
def f_clean_cascade(spark, d):
    c = F.col("conversations")
    return folded(spark, d).select("conv_id", F.size(c).cast("long").alias("turns"), V.total_chars(c).cast("long").alias("chars"), V.clean_reason(c).alias("reason"))


@query(_FOLD + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS \"rows\" FROM r GROUP BY 1")
def a_count_reasons(spark, d):
    c = folded(spark, d).select(F.coalesce(V.clean_reason(F.col("conversations")), F.lit("kept")).alias("reason"))
    return A.count_reasons(c, "reason")


@query(_FOLD + """, k AS (SELECT CAST(chars AS BIGINT) AS chars, row_number() OVER (ORDER BY chars) - 1 AS i, count(*) OVER () AS n FROM r)
SELECT max(CASE WHEN i = floor((n - 1) * 0.5) THEN chars END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.9) THEN chars END) AS p90, max(CASE WHEN i = floor((n - 1) * 0.99) THEN chars END) AS p99 FROM k""")
def a_floor_percentiles(spark, d):
    c = folded(spark, d).select(V.total_chars(F.col("conversations")).cast("long").alias("chars"), F.lit(1).alias("one"))
    return A.percentiles(c, "chars", [0.5, 0.9, 0.99], ["one"]).drop("one")


@query(_FOLD + """, h AS (SELECT t.conv_id, t.i + 1 AS at, t.v AS raw, (SELECT max(u.i) FROM t u WHERE u.conv_id = t.conv_id AND u.i < t.i AND u.who = 'human') AS j FROM t WHERE t.who = 'gpt')
SELECT h.conv_id, CAST(h.at AS BIGINT) AS at, md5(u.text) AS human, md5(g.text) AS gpt FROM h
JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) u ON u.conv_id = h.conv_id AND u.i = h.j
JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) g ON g.conv_id = h.conv_id AND g.i = h.at - 1""")
def c_dialog_pairs(spark, d):
    return V.pairs(folded(spark, d), "conv_id").select("conv_id", F.col("at").cast("long").alias("at"), F.md5("human").alias("human"), F.md5("gpt").alias("gpt"))


@query("""
SELECT conv_id, turn, coalesce(array_to_string(list(md5(text)) OVER w, ','), '') AS history, CAST(count(*) OVER w AS BIGINT) AS history_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def w_history(spark, d):
    t = table(spark, d, "conversations").withColumn("text", F.md5("text"))
    return G.history(t, "conv_id", "turn", "text").select("conv_id", "turn", F.array_join("history", ",").alias("history"), F.col("history_turns").cast("long").alias("history_turns"))


@query(r"""
WITH h AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS human, max(CASE WHEN turn = 1 THEN text END) AS gpt FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(gpt) < 40 THEN 'short_answer,' ELSE '' END || CASE WHEN length(human) > 1200 AND length(gpt) < 40 THEN 'long_prompt_short_answer,' ELSE '' END
  || CASE WHEN CAST(length(gpt) AS DOUBLE) / greatest(length(human), 1) < 0.02 THEN 'very_low_answer_prompt_ratio,' ELSE '' END || CASE WHEN dup > 1 THEN 'same_prompt_conflicting_labels,' ELSE '' END AS reasons
FROM (SELECT h.*, g.dup FROM h JOIN (SELECT human, count(DISTINCT gpt) AS dup FROM h GROUP BY human) g ON g.human IS NOT DISTINCT FROM h.human) WHERE human IS NOT NULL AND gpt IS NOT NULL""")
def f_audit_reasons(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("human"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("gpt"))
    t = R.conflicts(t.where("human is not null and gpt is not null"), "human", "gpt")
    r = V.audit_reasons(F.col("human"), F.col("gpt"), F.col("labels") > 1)
    return t.select("conv_id", F.concat(F.array_join(r, ","), F.when(F.size(r) > 0, ",").otherwise("")).alias("reasons"))


# Joins and sets (of J1-J15, U1-U6)


@query(r"""
WITH g AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]') AS w FROM benchmark),
x AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM g WHERE len(w) >= 8)),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]') AS w FROM documents),
y AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8))
SELECT doc_id, count(*) AS shared FROM y SEMI JOIN x USING (g) GROUP BY doc_id""")
def j_ngram_overlap(spark, d):
    return R.overlaps(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), 8)


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def j_attach_labels(spark, d):
    return R.attach(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey) ANTI JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def j_allow_and_exclude(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    out = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.exclude(R.allow(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey"), out, keys=["o_orderkey"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def u_first_of_key(spark, d):
    return R.first_of_key(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def j_last_wins(spark, d):
    return R.first_of_key(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"], last=True)


@query("""
WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN l_tax > 0.03 THEN 1.0 ELSE 0.0 END) AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a = 0 AND b > 0 THEN 'new_correct' WHEN a > 0 AND b = 0 THEN 'new_wrong' ELSE 'same' END AS change, count(*) AS "rows" FROM p GROUP BY 1""")
def j_paired_models(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount", "l_tax")
    t = scattered(t, "id", rows=ROWS_A_TASK // 2)  # both sums and the join are made where the ids are, of so many rows a task
    model = lambda c: t.groupBy("id").agg(F.max(c.cast("double")).alias("score"))
    return R.paired(model(F.col("l_discount") > 0.05), model(F.col("l_tax") > 0.03), "id", "score").groupBy("change").agg(F.count("*").alias("rows"))


@query("""
WITH a AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT n_name AS key, CAST(n_nationkey % 5 AS VARCHAR) AS v FROM nation WHERE n_nationkey % 4 <> 0)
SELECT coalesce(a.key, b.key) AS key, a.v AS "left", b.v AS "right", a.v IS NOT DISTINCT FROM b.v AS match FROM a FULL JOIN b ON a.key = b.key""")
def j_config_diff(spark, d):
    n = table(spark, d, "nation")
    side = lambda c, cond: n.where(cond).select(F.col("n_name").alias("key"), c.cast("string").alias("value"))
    return R.config_diff(side(F.col("n_regionkey"), "n_nationkey % 3 <> 0"), side(F.col("n_nationkey") % 5, "n_nationkey % 4 <> 0"))


@query("SELECT user_id, event_id, event_type, max(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events")
def j_prior_turn(spark, d):
    return R.prior_turn(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT n_nationkey, i AS candidate_index, CAST([0.2, 0.7, 1.0][i % 3 + 1] AS DOUBLE) AS temperature FROM nation, (SELECT unnest(range(0, 5)) AS i)")
def j_candidates(spark, d):
    return R.candidates(table(spark, d, "nation").select("n_nationkey"), 5, [0.2, 0.7, 1.0]).select("n_nationkey", F.col("candidate_index").cast("long").alias("candidate_index"), "temperature")


@query("SELECT event_type, user_id FROM (SELECT event_type, user_id, event_id, first(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) WHERE f = event_type")
def w_keep_first_label(spark, d):
    return R.keep_first_label(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id").select("event_type", "user_id")


# Aggregates (of A1-A32)


@query("""
WITH e AS (SELECT user_id, event_type = 'click' AS greedy, CAST(CAST(value > 20 AS INT) AS DOUBLE) AS ok, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY event_id) AS i FROM events)
SELECT user_id, max(CASE WHEN greedy THEN ok END) AS pass1_greedy, max(CASE WHEN NOT greedy AND i = 1 THEN ok END) AS pass1_sampled, max(CASE WHEN NOT greedy AND i <= 4 THEN ok END) AS pass4, max(CASE WHEN NOT greedy AND i <= 8 THEN ok END) AS pass8
FROM e GROUP BY user_id""")
def a_pass_at_k(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "greedy").otherwise("sampled").alias("generation_mode"), F.col("event_id").alias("candidate_index"), (F.col("value") > 20).cast("double").alias("answer_correct"))
    return A.passes(e, ["user_id"], [1, 4, 8])


@query("""
SELECT l_returnflag AS model, coalesce(l_shipmode, 'bucket_' || l_linestatus, 'macro_average') AS name, count(*) AS num_examples, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
FROM (SELECT *, 'task' || l_linenumber AS l_shipmode FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_shipmode), (l_returnflag, l_linestatus), (l_returnflag))""")
def a_roll_up(spark, d):
    t = table(spark, d, "lineitem").withColumn("task", F.concat(F.lit("task"), F.col("l_linenumber").cast("string"))).withColumnRenamed("l_returnflag", "model").withColumnRenamed("l_linestatus", "bucket")
    return A.roll_up(t, ["l_discount", "l_tax"])


@query("""
SELECT user_id, count(*) AS n, round(avg(value), 3) AS reward_mean, round(stddev_pop(value), 3) AS reward_std, sum(CAST(value > 20 AS BIGINT))::BIGINT AS n_correct, count(DISTINCT value) AS rewards,
  stddev_pop(value) <= 1e-8 AS zero_std, sum(CAST(value > 20 AS BIGINT)) = count(*) AS all_correct, sum(CAST(value > 20 AS BIGINT)) = 0 AS all_wrong,
  sum(CAST(value > 20 AS BIGINT)) > 0 AND sum(CAST(value > 20 AS BIGINT)) < count(*) AND count(DISTINCT value) > 1 AS mixed_reward FROM events GROUP BY user_id""")
def a_reward_groups(spark, d):
    e = table(spark, d, "events").withColumn("ok", F.col("value") > 20)
    g = A.group_statistics(e, ["user_id"], "value", "ok")
    return g.withColumn("reward_mean", F.round("reward_mean", 3)).withColumn("reward_std", F.round("reward_std", 3))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM c)
SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS kinds, round(sum(CASE WHEN k <= 2 THEN p END), 6) AS top_share FROM p GROUP BY user_id""")
def a_entropy(spark, d):
    e = A.entropy(table(spark, d, "events"), ["user_id"], "event_type", 2)
    return e.select("user_id", F.round("entropy", 6).alias("entropy"), "kinds", F.round("top_share", 6).alias("top_share"))


@query("""
WITH f AS (SELECT CASE WHEN NOT l_quantity > 10 THEN 0 WHEN NOT l_discount > 0.02 THEN 1 WHEN NOT l_tax < 0.07 THEN 2 ELSE 3 END AS f FROM lineitem), c AS (SELECT f, count(*) AS c FROM f GROUP BY f), n AS (SELECT sum(c) AS n FROM c)
SELECT v."at", step, CAST(n - coalesce((SELECT sum(c) FROM c WHERE f < v."at"), 0) AS BIGINT) AS input, CAST(coalesce((SELECT c FROM c WHERE f = v."at"), 0) AS BIGINT) AS filtered,
  CAST(n - coalesce((SELECT sum(c) FROM c WHERE f <= v."at"), 0) AS BIGINT) AS remaining FROM (VALUES (0, 'quantity'), (1, 'discount'), (2, 'tax')) v("at", step), n""")
def a_funnel(spark, d):
    steps = {"quantity": F.col("l_quantity") > 10, "discount": F.col("l_discount") > 0.02, "tax": F.col("l_tax") < 0.07}
    return A.funnel(table(spark, d, "lineitem"), steps).drop("examples")


@query("""
SELECT coalesce(CAST(w AS VARCHAR), 'overall') AS "window", count(*) AS "rows", round(avg(value), 6) AS value FROM
(SELECT value, (CAST(floor((day - 1) / 10) AS BIGINT) * 10 + 1) || '-' || (CAST(floor((day - 1) / 10) AS BIGINT) * 10 + 10) AS w FROM (SELECT value, dayofmonth(ts) AS day FROM events)) GROUP BY ROLLUP (w)""")
def a_step_windows(spark, d):
    e = table(spark, d, "events").withColumn("step", F.dayofmonth("ts"))
    return A.step_windows(e, "step", ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS \"rows\" FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a_distribution(spark, d):
    return A.distribution(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT event_type, count(*) AS \"rows\" FROM events GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 3")
def a_top(spark, d):
    return A.top(table(spark, d, "events"), "event_type", 3)


@query("SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) AS mse, round(avg(abs(l_discount - l_tax)), 9) AS mae, count(*) AS n FROM lineitem")
def a_errors(spark, d):
    e = A.errors(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return e.select(F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"), "n")


@query("""
SELECT lang, count(*) AS n_docs, sum(CAST(quality = 1 AS BIGINT))::BIGINT AS good, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic_rate, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a_audit_ratios(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.round(A.rate(F.col("toxic")), 6).alias("toxic_rate"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


# Windows, sampling, splits (W, L)


@query("""
SELECT user_id, event_id, value, CASE WHEN b = 1 THEN 'chosen' WHEN w = 1 AND n > 1 THEN 'rejected' END AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN b = 1 THEN 1 ELSE 0 END, value, event_id) AS w FROM (
    SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events))
WHERE b = 1 OR (w = 1 AND n > 1)""")
def w_best_and_worst(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return G.best_and_worst(e, ["user_id"], "value", "event_id").where("pick is not null")


@query("""
WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), s AS (SELECT *, c * least(200, sum(c) OVER ()) / sum(c) OVER () AS share, least(200, sum(c) OVER ()) AS want FROM c),
b AS (SELECT *, floor(share) AS base, share - floor(share) AS rest FROM s),
q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents)
SELECT r.doc_id, r.lang FROM r JOIN q USING (lang) WHERE k <= quota""")
def w_stratified_sample(spark, d):
    return L.stratified(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 200, 7, "doc_id")


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id)) AS k FROM documents) ORDER BY k, source LIMIT 50""")
def w_round_robin(spark, d):
    return L.round_robin(table(spark, d, "documents").select("doc_id", "source"), ["source"], 50, L.order_key(3, F.col("doc_id")))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 10")
def w_first_n(spark, d):
    return L.per_stratum(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 10, F.col("doc_id"))


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 100")
def l_seeded_take(spark, d):
    return L.take(table(spark, d, "documents").select("doc_id"), 100, 11, "doc_id")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.1, 0)) THEN 'valid' ELSE 'train' END AS split FROM documents""")
def l_split(spark, d):
    return L.split(table(spark, d, "documents").select("doc_id"), 0.1, 5, "doc_id")


@query("SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16) AS BIGINT) AS part FROM documents")
def l_chunks(spark, d):
    return L.chunks(table(spark, d, "documents").select("doc_id", "source"), 16, "doc_id", ["source"])


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('9:' || doc_id)) AS k FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN 'main' ELSE 'replay' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'en' ORDER BY md5('9:' || doc_id), doc_id) AS k FROM documents) WHERE k <= CASE WHEN lang = 'en' THEN 65 ELSE 35 END""")
def l_ratio_mix(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    return L.mix({"main": (t.where("lang = 'en'"), 0.65), "replay": (t.where("lang <> 'en'"), 0.35)}, 100, 9, "doc_id").select("doc_id", "part")


# Buckets (of B1-B8)

_DIAGNOSTICS = """
WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
x AS (SELECT user_id, count(*) FILTER (k BETWEEN 2 AND 9) AS n, count(*) FILTER (k BETWEEN 2 AND 9 AND value > 25) AS r, count(*) FILTER (k BETWEEN 2 AND 9 AND value > 25 AND event_id % 2 = 0) AS c,
  count(*) FILTER (k BETWEEN 2 AND 9 AND value > 4 AND value <= 25) AS w, count(*) FILTER (k BETWEEN 2 AND 9 AND value <= 4) AS b, max(CASE WHEN k = 1 THEN value END) > 25 AS g FROM s GROUP BY user_id)
"""


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 9")
    s = F.struct("k", (F.col("value") > 25).alias("correct"), (F.col("value") > 4).alias("executable"), (F.col("event_id") % 2 == 0).alias("clean"))
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("k") == 1, F.col("value") > 25)).alias("greedy_correct"), F.array_sort(F.collect_list(F.when(F.col("k") > 1, s))).alias("scores"))
    return g.withColumn("noisy", F.lit(False))


@query(_DIAGNOSTICS + """
SELECT user_id, CASE WHEN g THEN 'easy' WHEN n = 0 THEN 'hard' WHEN r > 0 THEN 'learnable-hard' WHEN (r + w) / CAST(n AS DOUBLE) < 0.5 THEN 'invalid-prone' ELSE 'hard' END AS bucket,
  CASE WHEN n > 0 AND b / CAST(n AS DOUBLE) > 0.5 THEN 'invalid_prone' WHEN g AND c > 0 AND w > 0 THEN 'retention_variance' WHEN g AND n > 0 AND r = n THEN 'all_correct' WHEN g THEN 'easy' WHEN c > 0 AND w > 0 THEN 'frontier'
    WHEN c = 0 AND r = 0 THEN 'all_wrong' WHEN r > 0 AND w = 0 THEN 'all_correct' ELSE 'noisy' END AS label, CAST(n AS INT) AS n FROM x""")
def b_difficulty(spark, d):
    t = diagnostics(spark, d)
    return t.select("user_id", C.learnable_bucket(F.col("noisy"), F.col("greedy_correct"), F.col("scores")).alias("bucket"), C.frontier_label(F.col("noisy"), F.col("greedy_correct"), F.col("scores")).alias("label"), F.size("scores").alias("n"))


# The flagship: scores of program predictions, by task


def predictions(spark: SparkSession, d: str) -> DataFrame:
    t = programs(spark, d).where("k <= 3")
    response = F.concat(F.lit("Evidence:\n- the value "), F.col("p").cast("string"), F.lit(" against "), F.col("q").cast("string"), F.lit("\n\nProgram: "), F.col("program"))
    gold = F.format_string("divide(subtract(%d, %d), %d)", F.col("p"), F.col("q"), F.col("q"))
    value = (F.col("p") - F.col("q")) / F.col("q").cast("double")
    return t.select("l_orderkey", "l_linenumber", "p", "s", "k", response.alias("prediction"), gold.alias("gold_program"), F.format_string("%.9f", value).alias("gold_answer"))


@query(_PROGRAMS + """, v AS (SELECT k, (p - q) / CAST(q AS DOUBLE) AS g, CASE k WHEN 2 THEN (p + q + s) / CAST(3 AS DOUBLE) WHEN 3 THEN NULL ELSE (p - q) / CAST(q AS DOUBLE) END AS e FROM t WHERE k <= 3)
SELECT 'task' || k AS task, count(*) AS num_examples, round(avg(CASE WHEN abs(e - g) <= greatest(1e-4 * greatest(abs(e), abs(g)), 1e-4) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS answer_accuracy,
  CAST(1 AS DOUBLE) AS program_parse_rate, round(avg(CASE WHEN e IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END), 6) AS program_execution_rate, round(avg(CASE WHEN k = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS program_string_accuracy,
  CAST(1 AS DOUBLE) AS structured_response_coverage FROM v GROUP BY k""")
def flagship_scoring(spark, d):
    s = scoring.score_numeric(predictions(spark, d))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return s.groupBy(F.concat(F.lit("task"), F.col("k").cast("string")).alias("task")).agg(
        F.count("*").alias("num_examples"), mean("answer_correct", "answer_accuracy"), mean("program_parse_rate", "program_parse_rate"), mean("program_execution_rate", "program_execution_rate"),
        mean("program_string_accuracy", "program_string_accuracy"), mean("structured_response_coverage", "structured_response_coverage"),
    )


# Sequences (M1-M5)


@query(r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents), o AS (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY source)
SELECT source, CAST(b AS BIGINT) AS block, CASE WHEN total < 512 THEN total ELSE 512 END::BIGINT AS n FROM (SELECT source, total, unnest(range(0, CASE WHEN total < 512 THEN 1 ELSE total // 512 END)) AS b FROM o)""")
def m_pack_blocks(spark, d):
    words = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.crc32(w.cast("binary")))
    t = table(spark, d, "documents").select("doc_id", "source", words.alias("tokens"))
    return Q.pack(t, "tokens", "doc_id", "source", 512).select("source", "block", F.size("tokens").cast("long").alias("n"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len) FROM dl) AS mean),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term)
SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id) JOIN q USING (term), n GROUP BY item_id, doc_id""")
def m_bm25(spark, d):
    return Q.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumn("score", F.round("score", 6))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda x: trim(x, E' \t\n\r\v\f')), lambda x: x <> '') AS s FROM documents),
w(doc_id, s, i, chunk, n, made) AS (SELECT doc_id, s, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), 0, CAST(NULL AS VARCHAR) FROM p WHERE len(s) > 0 UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN i = len(s) THEN chunk WHEN "full" THEN list_append(chunk[len(chunk) - back + 1:], s[i + 1]) ELSE list_append(chunk, s[i + 1]) END, n + "full"::INT, CASE WHEN "full" OR i = len(s) THEN array_to_string(chunk, ' ') END FROM (
    SELECT *, coalesce(len(chunk) > 0 AND list_sum(list_transform(chunk, lambda x: length(x))) + len(chunk) + length(s[i + 1]) > 220, false) AS "full",
      list_max(list_filter(range(0, len(chunk) + 1), lambda k: coalesce(list_sum(list_transform(chunk[len(chunk) - k + 1:], lambda x: length(x))), 0) <= 40)) AS back FROM w WHERE i <= len(s)))
SELECT doc_id, CAST(n - (i <= len(s))::INT AS INTEGER) AS at, made AS chunk FROM w WHERE made IS NOT NULL""")
def m_sentence_chunks(spark, d):
    return Q.sentence_chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def m_dialog_ids(spark, d):
    p = V.pairs(folded(spark, d), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "human", "gpt"))).alias("pairs"))
    return p.select("conv_id", Q.dialog_ids(F.col("pairs")).alias("x")).select("conv_id", "x.ids", "x.labels")


# Preference pairs, flags, stop rules and further windows


@query(r"""
WITH h AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN trim(text, E' \t\n\r') END) AS q, max(CASE WHEN turn = 1 THEN trim(text, E' \t\n\r') END) AS c, max(CASE WHEN turn = 3 THEN trim(text, E' \t\n\r') END) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(q, '') = '' THEN 'empty_question' WHEN coalesce(c, '') = '' THEN 'empty_chosen' WHEN coalesce(r, '') = '' THEN 'empty_rejected' WHEN c = r THEN 'identical_pair'
  WHEN length(r) < greatest(24, floor(length(c) * CAST(0.2 AS DOUBLE))) THEN 'rejected_too_short' END AS reason FROM h""")
def f_dpo_reasons(spark, d):
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(at(0).alias("q"), at(1).alias("c"), at(3).alias("r"))
    return t.select("conv_id", V.dpo_reason(F.col("q"), F.col("c"), F.col("r")).alias("reason"))


@query("""
SELECT flag, count(*) AS "rows" FROM (SELECT unnest([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN n_chars < 200 THEN 'short' END]) AS flag
FROM documents LEFT JOIN labels USING (doc_id)) WHERE flag IS NOT NULL GROUP BY flag""")
def a_count_flags(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality").isNull(), "unlabelled"), F.when(F.col("n_chars") < 200, "short")))
    return A.count_flags(j.select(flags.alias("flags")), "flags")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN value < 8 THEN CAST(0 AS DOUBLE) ELSE value END AS rs, value < 20 AS z, CAST(event_id % 10 AS DOUBLE) / 10 AS x, event_id % 97 = 0 AS mk, value > 30 AS mp, value < 15 AS w, event_id % 89 = 0 AS bad FROM events)
SELECT user_id, event_id, CASE WHEN bad THEN 'numerical_instability' WHEN count(*) OVER t5 = 5 AND bool_and(w) OVER t5 THEN 'zero_reward_variance' WHEN count(*) OVER t3 = 3 AND bool_and(mp) OVER t3 THEN 'execution_contract_regression'
  WHEN bool_or(mk) OVER a THEN 'execution_contract_regression' WHEN (count(*) OVER t5 = 5 AND max(rs) OVER t5 <= 1e-8) OR (count(*) OVER t10 = 10 AND avg(CAST(z AS DOUBLE)) OVER t10 >= 0.8) THEN 'zero_reward_variance'
  WHEN count(*) OVER t10 = 10 AND avg(x) OVER t10 < 0.7 THEN 'execution_contract_regression' END AS stop
FROM e WINDOW t10 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), t5 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  t3 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id)""")
def w_early_stop(spark, d):
    return G.early_stop(trace(table(spark, d, "events")), "user_id", "event_id").select("user_id", "event_id", "stop")


def trace(events: DataFrame) -> DataFrame:
    """Events as the trace of a run a user."""
    v, n = F.col("value"), F.col("event_id")
    flag = lambda c: c.cast("double")
    return events.select(
        "user_id", "event_id", F.when(v < 8, 0.0).otherwise(v).alias("reward_std"), (v < 20).alias("zero_std"), ((n % 10).cast("double") / 10).alias("executable_rate"), flag(n % 97 == 0).alias("marker_rate"),
        flag(v > 30).alias("multiple_program_rate"), (v < 15).alias("all_wrong"), F.when(n % 89 == 0, float("nan")).otherwise(1.0).alias("loss"),
    )


@query("""
WITH p AS (SELECT DISTINCT event_type AS bucket, user_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY user_id) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM p),
b AS (SELECT bucket, user_id, CAST(floor(k / 4) AS BIGINT) AS bundle FROM n WHERE (floor(k / 4) + 1) * 4 <= n)
SELECT bucket, bundle, event_id % 3 AS generation, round(sum(value), 4) AS total FROM events JOIN b ON b.bucket = event_type AND b.user_id = events.user_id GROUP BY ALL""")
def w_bundles(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("bucket"), "user_id", (F.col("event_id") % 3).alias("generation"), "value")
    return A.bundles(e, "bucket", "user_id", "generation", "value", 4).select("bucket", "bundle", "generation", F.round("total", 4).alias("total"))


@query("""
SELECT event_type AS name, round(avg(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END), 6) AS mean, count(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END) AS n FROM events GROUP BY event_type""")
def a_metric_means(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return A.metric_means(e).withColumn("mean", F.round("mean", 6))


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('2:' || doc_id)) <= 20 THEN 'pilot' ELSE 'extension' END AS phase FROM documents""")
def w_phases(spark, d):
    return L.phases(table(spark, d, "documents").select("doc_id", "lang"), 20, ["lang"], 2, "doc_id").select("doc_id", "phase")


@query("""
SELECT 'r' || c_custkey AS record_id, CASE WHEN c_acctbal < 0 THEN 'target_leakage_winner' ELSE '' END AS leak, c_acctbal < 0 AND c_custkey % 2 = 0 AS clean,
  CASE WHEN c_acctbal < 0 THEN 'B' WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'C' END AS tier FROM customer""")
def f_leakage_and_tier(spark, d):
    c = table(spark, d, "customer")
    winner = F.concat(F.lit("Program: add("), F.col("c_custkey").cast("string"), F.lit(", 1)"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("\nAnswer: 2"))
    low = F.col("c_acctbal") < 0
    prompt = F.concat(F.lit("Question?\n"), F.when(low, winner).otherwise(""))
    flags = F.when(low, F.array(F.lit("question_semantic_risk"))).when(F.col("c_custkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("program_parse_or_execute_error:x")))
    return c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("record_id"), C.leakage(prompt, winner=winner).alias("leak"), (low & C.clean_rollout(winner)).alias("clean"), C.tier(flags).alias("tier"))


from . import catalog_more, catalog_rows, catalog_turns  # noqa: E402, F401  (they register their queries)
