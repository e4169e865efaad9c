"""Training records from raw rows: supervision with evidence, answer, flags and tier; prompts, targets and items.

A raw row has record_id, question, program, answer, exe_ans (strings), pre_text and post_text (array<string>),
table (array<array<string>>) and gold (array<struct<raw_id, text>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import numbers as N
from ..functions import program as P
from ..functions import text as X
from ..operators import gates
from .scoring import align, choose_answer, plain, render_target


def blocks(pre: Column, post: Column) -> Column:
    """array<struct<location, text, plain>> of the text before and after a table."""
    of = lambda c, name: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("location"), x.alias("text"), plain(x).alias("plain")))
    return F.concat(of(pre, "pre_text"), of(post, "post_text"))


def sentence_for_table(evidence: Column, texts: Column, numbers: Column, chars: int = 400) -> Column:
    """Evidence items, those of the table replaced by the first text block that has two of the program's
    numbers or more, if there is one."""
    # tokens and texts are taken apart once each, not once a pair
    count = lambda t, forms: X.bind(N.seen_numbers(t), lambda s: F.size(F.filter(forms, lambda n: N.sees(s, n))))
    hit = X.bind(F.transform(numbers, N.token_form), lambda forms: F.try_element_at(F.filter(texts, lambda b: count(b["text"], forms) >= 2), F.lit(1)))

    def one(e: Column, h: Column) -> Column:
        swap = (e["evidence_type"] == "table") & h.isNotNull()
        text = F.when(swap, X.truncate(X.normalize_ws(h["text"]), chars)).otherwise(e["rendered_text"])
        return F.struct(
            F.when(swap, "text").otherwise(e["evidence_type"]).alias("evidence_type"), e["raw_id"].alias("raw_id"), F.when(swap, h["location"]).otherwise(e["source_location"]).alias("source_location"),
            text.alias("rendered_text"), e["match_type"].alias("match_type"),
        )

    swapped = X.bind(hit, lambda h: F.transform(evidence, lambda e: one(e, h)))
    return F.when(F.array_contains(evidence["evidence_type"], "table"), swapped).otherwise(evidence)


def supervision(df: DataFrame, *, facts: int = 3, chars: int = 400) -> DataFrame:
    """``df`` with its supervision: program and its value, aligned evidence, answer, unit, scale, flags, tier.

    The program runs once a row; everything else is built-in functions."""
    c = F.col
    d = X.computed(df, program_canonical=P.canonicalize(X.to_text(c("program"))), _blocks=blocks(c("pre_text"), c("post_text"))).withColumn("_run", P.execute("program_canonical"))
    d = X.computed(d, program_executable=c("_run.value"), program_numbers=N.number_tokens(c("program_canonical")), _aligned=align(c("gold"), c("_blocks"), c("table"), facts, chars))
    d = X.computed(d, _swapped=sentence_for_table(c("_aligned"), c("_blocks"), c("program_numbers"), chars))
    pruned = lambda e: e.withField("rendered_text", X.pruned_columns(e["rendered_text"], c("question"), chars))
    every = F.transform("_swapped", lambda e: F.when(e["evidence_type"] == "table", pruned(e)).otherwise(e))
    d = X.computed(d, _pruned=F.when(F.array_contains("_swapped.evidence_type", "table"), every).otherwise(c("_swapped")))
    d = choose_answer(d.withColumnRenamed("_pruned", "aligned_evidence"), "answer", "exe_ans", "program_executable")
    d = X.computed(d, answer_display=N.answer_display(c("answer"), c("answer_norm"), c("question")), _evidence=F.array_join("aligned_evidence.rendered_text", " "))
    unit, scale = N.unit_and_scale(c("question"), c("answer"), c("answer_display"))
    flags = X.told(
        c("_run.error"), F.when(F.size("aligned_evidence") == 0, "missing_evidence"), F.when(F.size(F.array_remove("_aligned.match_type", "exact")) > 0, "non_exact_evidence_alignment"),
        F.when(X.to_text(c("question")) == "", "missing_question"), F.when(X.to_text(c("program")) == "", "missing_program_re"),
    )
    semantic = X.told(
        F.when(C.semantic_risk(c("question"), c("_evidence")), "question_semantic_risk"), F.when(c("_swapped") != c("_aligned"), "table_evidence_replaced_by_text"), F.when(X.suspicious_question(c("question")), "suspicious_question_text")
    )
    d = X.computed(d, answer_unit=unit, answer_scale=scale, audit_flags=F.sort_array(F.array_distinct(F.concat(flags, "_answer_flags"))), semantic_audit_flags=F.sort_array(semantic))
    d = X.computed(d, quality_tier=C.tier(F.concat("audit_flags", "semantic_audit_flags")), answer_source=F.when(c("program_executable").isNotNull(), "program_executable").otherwise("raw_answer"))
    return d.drop("_run", "_blocks", "_aligned", "_swapped", "_answer_flags", "_evidence")


def with_prompt(df: DataFrame, system: str, output_format: str, history: str | None = None) -> DataFrame:
    """``df`` with ``prompt`` and ``target``, and with the flag of evidence that the prompt doesn't show."""
    c = F.col
    context = X.context_sections(c("pre_text"), c("table"), c("post_text"))
    made = X.prompt(system=system, context=c("_context"), question=X.clean_question(c("question")), history=c(history) if history else None, output_format=output_format)
    d = X.computed(X.computed(df, _context=context), prompt=made, _texts=c("aligned_evidence.rendered_text"))
    unseen = F.when(~gates.visible(c("_texts"), c("prompt")), F.array(F.lit("evidence_not_in_rendered_prompt"))).otherwise(F.array().cast("array<string>"))
    d = X.computed(d, target=render_target(c("_texts"), c("program_canonical"), c("answer_display"), c("answer_norm")), _flags=F.sort_array(F.array_distinct(F.concat("audit_flags", unseen))))
    d = X.computed(d.drop("quality_tier"), quality_tier=C.tier(F.concat("_flags", "semantic_audit_flags")))
    return d.withColumn("audit_flags", c("_flags")).drop("_flags", "_texts", "_context")


def sft_items(df: DataFrame, tiers: str = "A") -> DataFrame:
    """(record_id, conversations) of the records whose tier is allowed."""
    from ..operators.conversations import sharegpt

    return df.where(gates.listed(F.col("quality_tier"), tiers, "A")).select("record_id", sharegpt(F.col("prompt"), F.col("target")).alias("conversations"))


# Lines of a rejected response that lacks them.
NO_PROGRAM, NO_ANSWER = "Program: use a nearby unsupported calculation", "0"


def rejected_response(chosen: Column) -> Column:
    """A response whose program lines have an operator swapped and whose answer lines have a number moved; a line
    that is missing is added, wrong."""
    lines = F.split(chosen, "\n")
    body = lambda x, head: X.strip(F.substr(x, F.lit(len(head) + 1)))
    swap = lambda head, f: lambda x: F.concat(F.lit(f"{head} "), f(body(x, head)))
    program, answer = swap("Program:", P.mutate), swap("Answer:", N.mutate_number)
    changed = F.transform(lines, lambda x: F.when(x.startswith("Program:"), program(x)).when(x.startswith("Answer:"), answer(x)).otherwise(x))
    missing = lambda head, line: F.when(~F.exists(lines, lambda x: x.startswith(head)), line)
    more = F.array_compact(F.array(missing("Program:", F.lit(NO_PROGRAM)), missing("Answer:", F.concat(F.lit("Answer: "), N.mutate_number(F.lit(NO_ANSWER))))))
    return F.array_join(F.concat(changed, more), "\n")


def dpo_items(df: DataFrame, tiers: str = "A") -> DataFrame:
    """(record_id, question, response_chosen, response_rejected): the target against one with program and answer made wrong."""
    rejected = rejected_response(F.col("target"))
    return df.where(gates.listed(F.col("quality_tier"), tiers, "A")).select("record_id", F.col("prompt").alias("question"), F.col("target").alias("response_chosen"), rejected.alias("response_rejected"))


def item_pairs(df: DataFrame, tiers: str = "A") -> DataFrame:
    """(record_id, conversations, question, response_chosen, response_rejected): what ``sft_items`` and ``dpo_items`` make of a
    record, from one pass. A rejected response is made once, however many conditions it is held against."""
    from ..operators.conversations import sharegpt

    kept = df.where(gates.listed(F.col("quality_tier"), tiers, "A")).select("record_id", F.col("prompt").alias("question"), F.col("target").alias("response_chosen"))
    made = X.computed(kept, response_rejected=rejected_response(F.col("response_chosen")))
    return made.select("record_id", sharegpt(F.col("question"), F.col("response_chosen")).alias("conversations"), "question", "response_chosen", "response_rejected")


def audit_items(df: DataFrame) -> DataFrame:
    """What a reviewer needs of each record."""
    texts = F.col("aligned_evidence.rendered_text")
    return df.select("record_id", "question", "program_canonical", "program_executable", "answer_norm", texts.alias("evidence"), F.concat("audit_flags", "semantic_audit_flags").alias("flags"), "quality_tier")


def templated_items(df: DataFrame, template: str, answer: str, rejected: str) -> DataFrame:
    """(record_id, conversations, response_rejected): a question in a template (``{{ question }}``), its answer,
    and one rejected response for all."""
    from ..operators.conversations import sharegpt

    return df.select("record_id", sharegpt(X.render_template(template, question=F.col("question")), X.to_text(F.col(answer))).alias("conversations"), F.lit(rejected).alias("response_rejected"))


def choice_examples(df: DataFrame, answers: list[str]) -> DataFrame:
    """(record_id, prompt, gold): question and lettered options; gold is the first of the answer columns that
    gives a letter."""
    letters = (F.nullif(X.option_letter(F.col(c)), F.lit("")) for c in answers)
    return df.select("record_id", X.join_parts(F.col("question"), X.options(F.col("options"))).alias("prompt"), F.coalesce(*letters, F.lit("")).alias("gold"))


def training_rows(df: DataFrame) -> DataFrame:
    """Supervised records as rows for training with rewards, with ``reason`` (null where a row is usable)."""
    program = F.col("program_canonical")
    run = F.struct(F.col("program_executable").alias("value"), F.when(F.col("program_executable").isNull(), F.lit("x")).alias("error"))
    kind = C.question_type(F.col("question"), program)
    metadata = F.struct(
        kind.alias("question_type"), C.answer_scale(F.col("question"), program, F.col("answer_norm")).alias("answer_scale"), F.col("answer_unit"), P.ops(program).alias("program_ops"),
        F.size(P.ops(program)).alias("program_step_count"), P.arguments(program).alias("program_numeric_args"), (kind == "direct_lookup").alias("direct_lookup"),
    )
    return df.select("record_id", F.col("prompt").alias("input_prompt_raw"), F.col("answer_norm").alias("gold_answer"), program.alias("gold_program"), F.col("target").alias("reference_response"), metadata.alias("metadata"), gates.target_reason(F.split_part(F.col("target"), F.lit("\n\nAnswer:"), F.lit(1)), program, run).alias("reason"))


def annotated(df: DataFrame, scores: str = "scores", predictions: str = "predictions") -> DataFrame:
    """``df`` with ``winner``, the first clean right prediction, and ``negative``, the first wrong one that ran.
    scores: array<struct<correct, executable, clean>>, as long as predictions."""
    both = F.arrays_zip(F.col(scores).alias("s"), F.col(predictions).alias("p"))
    first = lambda f: F.try_element_at(F.filter(both, lambda x: f(x["s"])), F.lit(1))["p"]
    return df.withColumn("winner", first(lambda s: s["correct"] & s["clean"])).withColumn("negative", first(lambda s: s["executable"] & ~s["correct"]))


def preference_pair(greedy_correct: Column, greedy: Column, scores: Column, predictions: Column) -> Column:
    """struct<chosen, rejected>: the first right sample against the greedy prediction if that is wrong, else
    against the first wrong sample that ran; null without both."""
    both = F.arrays_zip(scores.alias("s"), predictions.alias("p"))
    first = lambda f: F.try_element_at(F.filter(both, lambda x: f(x["s"])), F.lit(1))["p"]
    chosen = first(lambda s: s["correct"])
    rejected = F.when(~F.coalesce(greedy_correct, F.lit(True)), greedy).otherwise(first(lambda s: s["executable"] & ~s["correct"]))
    return F.when(chosen.isNotNull() & rejected.isNotNull(), F.struct(chosen.alias("chosen"), rejected.alias("rejected")))


def synthetic_rejects(df: DataFrame, order: str, most: int = 2, modes: tuple[str, ...] = ("answer_perturb", "think_empty", "think_program")) -> DataFrame:
    """(…, mode, response): worse variants of a tagged ``response`` (one row a record, with ``program``), at most
    ``most`` of each, the mode that comes first taken in turn by a hash of ``order``. A mode that changes
    nothing makes none."""
    r = F.col("response")
    made = {
        "answer_perturb": X.replace_tag(r, "answer", X.perturbed_answer(X.tag(r, "answer"))),
        "think_empty": X.replace_tag(r, "think", F.lit("")),
        "think_program": F.when(X.to_text(F.col("program")) != "", X.replace_tag(r, "think", F.col("program"))),
    }
    turn = F.pmod(F.crc32(F.col(order).cast("string").cast("binary")), F.lit(len(modes))).cast("int")
    every = F.array(*(F.struct(F.lit(m).alias("mode"), made[m].alias("response")) for m in modes))
    turned = F.concat(F.slice(every, turn + 1, F.lit(len(modes))), F.slice(every, F.lit(1), turn))
    usable = F.filter(turned, lambda x: x["response"].isNotNull() & (x["response"] != r))
    full = r.rlike(r"(?is)^\s*<think>.*</think>\s*<answer>.*</answer>\s*$")
    return df.where(full).select(*(c for c in df.columns if c != "response"), F.inline(F.slice(usable, 1, most)))
