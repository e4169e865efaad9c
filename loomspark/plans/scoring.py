"""Scoring of predictions against gold programs and answers, and selection by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import numbers as N
from ..functions import program as P
from ..functions import text as X

#: Anchors that a structured response has, by output format.
STRUCTURE = {
    "program_executor": ("Evidence:", "Program:"),
    "cot_program": ("Reasoning:", "Evidence:", "Program:"),
    "answer_first_reasoning_program": ("Reasoning:", "Evidence:", "Program:", "Answer:"),
    "program_first_answer": ("Evidence:", "Program:", "Answer:"),
}


def score_numeric(df: DataFrame, *, prediction: str = "prediction", gold_answer: str = "gold_answer", gold_program: str = "gold_program", output: str = "program_executor", rel: float = 1e-4, abs_: float = 1e-4) -> DataFrame:
    """``df`` with the scores of a program prediction: coverage, contract, execution, accuracy, grounding.

    The program is run once per row; answers are compared in double precision."""
    p = F.col(prediction)
    d = X.computed(df, program_section=X.program_section(p), evidence=X.evidence_section(p), gold_number=N.parse_answer(F.col(gold_answer)), answer_number=N.parse_answer(p))
    d = d.withColumn("executed", P.execute(P.canonicalize(F.col("program_section"))))
    value, gold = F.col("executed.value"), F.col("gold_number")
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    executed_right = one(N.close(value, gold, rel, abs_))
    model_right = one(N.close(F.col("answer_number"), gold, rel, abs_))
    explicit = (X.normalized_answer(p) != "") | (X.display_answer(p) != "")
    text_right = (X.comparable_answer(p) == X.comparable_answer(F.col(gold_answer))).cast("double")
    primary = executed_right if output != "answer_first_reasoning_program" else F.when(explicit & F.col("answer_number").isNotNull(), model_right).otherwise(executed_right)
    bullets = X.bullet_count(F.col("evidence"))
    lines = F.size(F.filter(F.split("program_section", "\n"), lambda x: F.trim(x) != ""))
    contract = (bullets <= 2) & (F.length("evidence") <= 180) & (lines == 1) & ~X.post_program_text(p)
    same = F.regexp_replace(F.lower("program_section"), r"\s+", "") == F.regexp_replace(F.lower(F.col(gold_program)), r"\s+", "")
    return d.select(
        "*",
        F.when(gold.isNull(), text_right).otherwise(primary).alias("answer_correct"),
        one(F.col("program_section") != "").alias("program_parse_rate"),
        one(value.isNotNull()).alias("program_execution_rate"),
        executed_right.alias("executed_answer_accuracy"),
        model_right.alias("model_normalized_answer_accuracy"),
        F.when(value.isNotNull() & F.col("answer_number").isNotNull(), one(N.close(value, F.col("answer_number"), rel, abs_))).alias("program_answer_consistency"),
        F.when(F.col(gold_program) != "", one(same)).alias("program_string_accuracy"),
        P.multiset_f1(P.ops(F.col("program_section")), P.ops(F.col(gold_program))).alias("operation_match_rate"),
        P.multiset_f1(P.arguments(F.col("program_section")), P.arguments(F.col(gold_program))).alias("argument_grounding_rate"),
        F.when(value.isNotNull(), P.scale_consistent(value, gold)).otherwise(F.lit(0.0)).alias("scale_consistency_rate"),
        P.grounding(F.col("program_section"), F.col("evidence")).alias("evidence_grounding_rate"),
        one(contract).alias("strict_program_contract_rate"),
        one(F.forall(F.array(*(F.lit(a) for a in STRUCTURE[output])), lambda a: p.contains(a))).alias("structured_response_coverage"),
    )


def gold_reason(program: Column, answer: Column, executed: Column) -> Column:
    """Why a row's gold program and answer don't agree; null if they do."""
    value, gold = executed["value"], N.parse_answer(answer)
    return (
        F.when(value.isNull(), F.coalesce(executed["error"], F.lit("gold_program_not_executable")))
        .when(gold.isNull(), "gold_answer_not_numeric")
        .when(~N.close(value, gold), "gold_program_answer_mismatch")
    )


def frontier(diagnostics: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics with their label, joined with the first source row of each key; missing ones are marked."""
    from ..operators.relations import attach, first_of_key

    labelled = diagnostics.withColumn("label", C.frontier_label(F.col("noisy"), F.col("greedy_correct"), F.col("scores")))
    return attach(labelled, first_of_key(rows, keys, ["ord"]), keys)


def choose_answer(df: DataFrame, raw: str, executed_answer: str, value: str) -> DataFrame:
    """``df`` with ``answer_norm`` and ``_answer_flags`` from the raw answer, the dataset's executed answer and the program's value.

    Each step is a column of its own, since an expression that is used twice is written out twice."""
    raw, executed_answer, value = F.col(raw), F.col(executed_answer), F.col(value)
    d = X.computed(df, _exe=N.parse_first(executed_answer), _raw=N.parse_first(raw))
    exe, number = F.col("_exe"), F.col("_raw")
    percent = F.coalesce(executed_answer.contains("%"), F.lit(False))
    d = X.computed(d, _agrees=value.isNotNull() & exe.isNotNull() & N.equivalent_of(value, exe, percent))
    agrees = F.col("_agrees")
    alone = value.isNotNull() & exe.isNull()
    shown = F.coalesce(F.nullif(X.to_text(executed_answer), F.lit("")), X.to_text(raw))
    norm = F.when(agrees, X.to_text(executed_answer)).when(alone, N.show(value)).otherwise(shown)
    d = X.computed(d, answer_norm=norm)
    norm = F.col("answer_norm")
    scaled = F.coalesce(raw.contains("%"), F.lit(False)) | F.coalesce(norm.contains("%"), F.lit(False))
    d = X.computed(d, _norm=N.parse_first(norm))
    n = F.col("_norm")
    flags = X.told(
        F.when(~(agrees | alone), "program_answer_mismatch"),
        F.when(number.isNotNull() & n.isNotNull() & ~N.equivalent_of(number, n, scaled), "raw_answer_mismatch_with_answer_norm"),
        F.when(norm == "", "missing_answer_norm"),
    )
    return X.computed(d, _answer_flags=flags).drop("_exe", "_raw", "_agrees", "_norm")


def plain(c: Column) -> Column:
    """A text as evidence is compared: white space collapsed, lower case."""
    return F.lower(X.normalize_ws(c))


def align(gold: Column, blocks: Column, table: Column, most: int = 3, chars: int = 400) -> Column:
    """Evidence items, array<struct<raw_id, text>>, held against text blocks, array<struct<location, text, plain>>,
    and table rows; the first ``most`` that aren't empty."""

    def parsed(g: Column) -> Column:
        # an empty text is made null first, since a cast that fails costs an exception inside Spark
        number = lambda kind: F.nullif(F.regexp_extract(g["raw_id"], rf"(?i)^{kind}_(\d+)$", 1), F.lit("")).try_cast("int")
        return F.struct(g["raw_id"].alias("raw_id"), X.normalize_ws(g["text"]).alias("text"), number("table").alias("row"), number("text").alias("hint"))

    def found(g: Column) -> Column:
        same = F.filter(blocks, lambda b: b["plain"] == F.lower(g["text"]))
        hinted = F.filter(F.array(F.try_element_at(blocks, g["hint"] + 1)), lambda b: b["plain"] == F.lower(g["text"]))
        cells = F.when(g["row"].isNotNull(), F.array_join(F.try_element_at(table, g["row"] + 1), " | "))
        in_table = F.when(F.coalesce(cells, F.lit("")) != "", F.concat(F.lit("table["), g["row"].cast("string"), F.lit("]")))
        in_text = F.try_element_at(F.concat(hinted, same), F.lit(1))["location"]
        shown = F.when(g["row"].isNotNull() & (g["text"] == ""), X.normalize_ws(cells)).otherwise(g["text"])
        return F.struct(g.alias("g"), F.when(g["row"].isNotNull(), in_table).otherwise(in_text).alias("location"), shown.alias("shown"))

    def one(f: Column) -> Column:
        g, location, shown = f["g"], f["location"], f["shown"]
        kind = F.when(g["row"].isNotNull(), "table").when(g["hint"].isNotNull() | location.isNotNull(), "text").otherwise("unknown")
        match = F.when(location.isNotNull(), "exact").otherwise("missing")
        return F.struct(kind.alias("evidence_type"), g["raw_id"].alias("raw_id"), F.coalesce(location, F.lit("")).alias("source_location"), X.truncate(shown, chars).alias("rendered_text"), match.alias("match_type"))

    items = F.transform(F.transform(F.transform(gold, parsed), found), one)
    return F.slice(F.filter(items, lambda e: e["rendered_text"] != ""), 1, most)


def render_target(evidence: Column, program: Column, display: Column, norm: Column, variant: str = "benchmark_sft") -> Column:
    """The training target: evidence bullets, program and, by variant, answer lines."""
    lines = F.array_join(F.concat(F.array(F.lit("Evidence:")), F.transform(F.filter(evidence, lambda e: e != ""), lambda e: F.concat(F.lit("- "), e))), "\n")
    parts = [lines, F.concat(F.lit("Program: "), program)]
    answer = F.coalesce(F.nullif(display if variant in ("assistant_sft", "dual_answer_sft") else norm, F.lit("")), norm)
    if variant != "program_executor_sft":
        parts.append(F.concat(F.lit("Answer: "), answer))
    if variant == "dual_answer_sft":
        parts.append(F.concat(F.lit("Normalized Answer: "), norm))
    return F.concat_ws("\n\n", *parts)
