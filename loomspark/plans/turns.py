"""Records of conversations with annotated turns: what a turn asks and answers, and the history it may lean on.

A turn record has id, conversation_id, filename, question, program_re, answer, exe_ans (strings), turn_ind (int), pre_text, post_text, table
and gold as a raw row of ``records``, qa struct<question, program_re, answer, exe_ans> and annotation struct<cur_dial, dialogue_break: array<string>,
turn_ind: int, cur_program, exe_ans: string, turn_program, exe_ans_list, answer_list: array<string>>; and ``ord``, its place in the source.

The history of a turn are its last questions, each with the target that an annotation of this record gives it, else with that of the
last earlier turn of the conversation that asked the same. Both need supervision of the best tier. Every record is therefore stretched into
itself and the annotated turns it looks back on, at most ``turns`` of them; one pass supervises all; one window by (conversation, question) carries
each turn's target to the later turns that ask for it; one grouping puts the records together again. No step grows with more
than the number of turns, and no conversation is held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import gates
from . import records
from .scoring import render_target

#: Name of the first letter by which an answer is a placeholder, and what ends an id as a turn's number.
PLACEHOLDER, SUFFIX = "A", r"_([0-9]+)\z"


def _none(c: Column) -> Column:
    return F.nullif(X.to_text(c), F.lit(""))


def _clean(c: Column) -> Column:
    """Cleaned questions of an array, empty for null."""
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda q: F.coalesce(X.clean_question(q), F.lit("")))


def _filled(c: Column) -> Column:
    return F.filter(c, lambda q: q != "")


def answer_of(annotated: Column, executed: Column) -> Column:
    """The annotated answer, unless it is missing or a placeholder; then the executed one."""
    return F.when(F.upper(X.to_text(annotated)).startswith(PLACEHOLDER) | annotated.isNull(), executed).otherwise(annotated)


def turn_inputs(df: DataFrame) -> DataFrame:
    """``df`` with record_id, conversation_id, rank, question, prior (array), program, answer and exe_ans as the turn has them."""
    c, a, qa = F.col, (lambda n: F.col(f"annotation.{n}")), (lambda n: F.col(f"qa.{n}"))
    named = F.coalesce(_none(c("conversation_id")), _none(c("id")))
    turn = F.coalesce(c("turn_ind"), a("turn_ind"))
    number = lambda t: F.nullif(F.regexp_extract(X.to_text(t), SUFFIX, 1), F.lit("")).try_cast("int")
    rank = F.when(turn.isNotNull(), F.struct(turn.alias("turn"), F.lit(1).alias("from"))).otherwise(F.when(number(c("id")).isNotNull(), F.struct(number(c("id")).alias("turn"), F.lit(0).alias("from"))).otherwise(F.struct(F.lit(-1).alias("turn"), F.lit(-1).alias("from"))))
    d = X.computed(df, _dial=_clean(a("cur_dial")), _break=_clean(a("dialogue_break")), _turn=turn)
    inside = lambda xs: F.when((c("_turn") >= 0) & (c("_turn") < F.size(xs)), F.try_element_at(xs, c("_turn") + 1))
    asked = F.coalesce(F.nullif(F.try_element_at("_dial", F.lit(-1)), F.lit("")), F.nullif(inside(c("_break")), F.lit("")), X.clean_question(F.coalesce(_none(c("question")), qa("question"))), F.lit(""))
    before = lambda xs, n: F.slice(xs, F.lit(1), F.greatest(n, F.lit(0)))
    prior = _filled(before(c("_dial"), F.size("_dial") - 1))
    prior = F.when((F.size(prior) == 0) & c("_turn").isNotNull(), _filled(before(c("_break"), c("_turn")))).otherwise(prior)
    exe = F.coalesce(a("exe_ans"), c("exe_ans"), qa("exe_ans"))
    answer = F.coalesce(answer_of(inside(a("answer_list")), exe), _none(c("answer")), _none(qa("answer")))
    program = F.coalesce(_none(a("cur_program")), _none(c("program_re")), _none(qa("program_re")))
    made = {"question": asked, "prior": prior, "program": program, "answer": answer, "exe_ans": exe, "rank": rank, "record_id": X.to_text(c("id")), "conversation_id": F.coalesce(F.regexp_replace(named, SUFFIX, ""), X.to_text(c("filename")))}
    kept = [n for n in df.columns if n not in made and n not in ("id", "turn_ind", "filename", "program_re", "qa")]
    return X.computed(d, **{f"_{n}": v for n, v in made.items()}).select(*kept, *(c(f"_{n}").alias(n) for n in made))


def _lookups(turns: int, chars: int) -> Column:
    """array<struct<place, question, same>> of the last questions before a turn; ``same`` is what questions are compared by."""
    last = X.last_questions(F.col("prior"), turns, chars)
    return F.transform(last, lambda q, i: F.struct(i.alias("place"), q.alias("question"), X.comparable_question(q).alias("same")))


def _annotated() -> Column:
    """array<struct<place, question, same, program, answer, exe_ans>> of the annotated turns before a turn that its lookups ask for."""
    a = lambda n: F.col(f"annotation.{n}")
    asked = F.coalesce(F.when(F.size(a("dialogue_break")) > 0, a("dialogue_break")), a("cur_dial"))
    both = F.arrays_zip(asked.alias("q"), a("turn_program").alias("p"), a("exe_ans_list").alias("e"), a("answer_list").alias("r"))
    upper = F.least(F.size("prior"), F.size(asked), F.size(a("turn_program")))
    known = F.when(upper > 0, F.slice(both, F.lit(1), upper)).otherwise(F.slice(both, 1, 0))

    def one(x: Column, i: Column) -> Column:
        q, answer = F.coalesce(X.clean_question(x["q"]), F.lit("")), answer_of(x["r"], x["e"])
        return F.struct(i.alias("place"), q.alias("question"), X.comparable_question(q).alias("same"), x["p"].alias("program"), answer.alias("answer"), F.coalesce(answer, x["e"]).alias("exe_ans"))

    wanted = F.transform("_lookups", lambda k: k["same"])
    made = F.filter(F.transform(known, one), lambda x: (x["same"] != "") & F.array_contains(wanted, x["same"]))
    return F.coalesce(made, F.array().cast("array<struct<place:int,question:string,same:string,program:string,answer:string,exe_ans:string>>"))


def with_history(df: DataFrame, *, turns: int = 6, chars: int = 400, variant: str = "benchmark_sft") -> DataFrame:
    """Supervised turn records with ``history``, array<struct<question, target>> (target null for a question alone), full_turns, question_turns,
    repeated_questions, answer_in_history, requires_history and history_dependency. Turns go by (rank, ord)."""
    c = F.col
    d = X.computed(turn_inputs(df), _lookups=_lookups(turns, chars), _same=X.comparable_question(c("question")))
    own = F.struct(F.lit(-1).alias("place"), c("question"), c("_same").alias("same"), c("program"), c("answer"), c("exe_ans"))
    asked = ("question", "program", "answer", "exe_ans")
    d = d.withColumn("_asked", F.explode(F.concat(F.array(own), _annotated()))).drop("annotation", "prior", *asked)
    d = records.supervision(d.select("*", *(c(f"_asked.{n}").alias(n) for n in asked)))
    texts = F.transform("aligned_evidence", lambda e: e["rendered_text"])
    whole = (c("quality_tier") == "A") & (F.size("aligned_evidence") > 0) & (c("program_canonical") != "") & (c("answer_norm") != "")
    d = X.computed(d, _turn=F.when(whole, F.struct(c("question"), render_target(texts, c("program_canonical"), c("answer_display"), c("answer_norm"), variant).alias("target"))), _mine=c("_asked.place") < 0)

    # Events: 0 asks for a question's last target, 1 gives one, 2 is an annotated turn on its way to its record.
    payload = [n for n in d.columns if n not in ("ord", "_asked", "_turn", "_mine", "_lookups", "conversation_id", "rank")]
    row = F.struct(*payload)
    event = lambda kind, place, q, same, turn, whole_: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), q.alias("question"), same.alias("same"), turn.alias("turn"), whole_.alias("row"))
    nothing, no_turn = F.when(F.lit(False), row), F.when(F.lit(False), c("_turn"))
    asks = F.transform("_lookups", lambda k: event(0, k["place"], k["question"], k["same"], no_turn, nothing))
    gives = F.array(event(1, c("_asked.place"), c("question"), c("_same"), F.when(c("_same") != "", c("_turn")), row))
    brings = F.array(event(2, c("_asked.place"), c("question"), c("_asked.same"), c("_turn"), nothing))
    e = d.select("ord", "conversation_id", "rank", F.inline(F.when(c("_mine"), F.concat(asks, gives)).otherwise(brings)))
    earlier = Window.partitionBy("conversation_id", "same").orderBy("rank", "ord", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("prior", F.last(F.when(c("kind") == 1, c("turn")), ignorenulls=True).over(earlier))

    collected = lambda kind, *names: F.array_sort(F.collect_list(F.when(c("kind") == kind, F.struct(*names))))
    g = e.groupBy("ord").agg(
        F.any_value("conversation_id").alias("conversation_id"), F.any_value("rank")["turn"].alias("turn_ind"), F.first("row", ignorenulls=True).alias("row"), collected(0, "place", "question", "same", "prior").alias("asks"),
        collected(2, "place", "same", "turn").alias("brings"),
    )
    d = g.select("ord", "conversation_id", "turn_ind", "row.*", "asks", "brings")

    def found(k: Column) -> Column:
        here = F.try_element_at(F.filter("brings", lambda b: (b["same"] == k["same"]) & b["turn"].isNotNull()), F.lit(-1))["turn"]
        full = F.coalesce(here, k["prior"])
        return F.struct(F.coalesce(full["question"], k["question"]).alias("question"), full["target"].alias("target"))

    usable = F.filter("asks", lambda k: k["same"] != "")
    repeated = lambda k: (F.col("_same") != "") & (k["same"] == F.col("_same"))
    d = X.computed(d, history=F.transform(F.filter(usable, lambda k: ~repeated(k)), found), repeated_questions=F.size(F.filter(usable, repeated)))
    answer = c("answer_display") if variant == "assistant_sft" else c("answer_norm")
    line = F.concat(F.lit("Answer: "), answer)
    depends = C.history_dependency(c("question"), F.size("history") > 0)
    d = X.computed(d, history_dependency=depends, full_turns=F.size(F.filter("history", lambda h: h["target"].isNotNull())), answer_in_history=F.coalesce((answer != "") & F.exists("history", lambda h: F.coalesce(F.contains(h["target"], line), F.lit(False))), F.lit(False)))
    return d.withColumn("question_turns", F.size("history") - c("full_turns")).withColumn("requires_history", c("history_dependency") != "self_contained").drop("asks", "brings", "_same")


def history_text(history: Column) -> Column:
    """The history as a prompt shows it: with targets where there are any, else as a list of questions; null without turns."""
    full = F.exists(history, lambda h: h["target"].isNotNull())
    block = lambda h: F.when(h["target"].isNotNull(), F.concat(F.lit("Q: "), h["question"], F.lit("\n"), h["target"])).when(full, F.concat(F.lit("Q: "), h["question"])).otherwise(F.concat(F.lit("- "), h["question"]))
    heading = F.when(full, "Conversation history:").otherwise("Conversation history questions:")
    return F.when(F.size(history) > 0, F.concat(heading, F.lit("\n"), F.array_join(F.transform(history, block), "\n\n")))


#: Lines of the prompt.
SYSTEM = (
    "You are a financial conversational reasoning assistant.",
    "Use the conversation history and report context to identify supporting evidence, produce the executable program, and give the final answer.",
)
FORMAT = "Respond exactly in this format:\nEvidence:\n- ...\n\nProgram: ...\nAnswer: ..."


def turn_records(df: DataFrame, **settings) -> DataFrame:
    """``with_history`` with ``prompt`` and ``target``, what the record repeats of its history and evidence that the prompt doesn't show added to the flags, and the tier anew."""
    c = F.col
    d = with_history(df, **settings)
    texts = F.transform("aligned_evidence", lambda e: e["rendered_text"])
    target = render_target(texts, c("program_canonical"), c("answer_display"), c("answer_norm"))
    context = X.context_sections(c("pre_text"), c("table"), c("post_text"))
    made = F.concat_ws("\n\n", *(F.lit(x) for x in SYSTEM), history_text(c("history")), F.nullif(context, F.lit("")), F.concat(F.lit("Current question: "), c("question")), F.lit(FORMAT))
    d = X.computed(d, target=target, prompt=F.when(c("question") != "", made).otherwise(""))
    body = F.array_join(F.filter(F.transform(F.split("target", "\n"), X.strip), lambda x: (x != "") & ~x.startswith("Evidence:") & ~x.startswith("- ")), "\n")
    asked, targets = F.transform("history", lambda h: h["question"]), F.transform("history", lambda h: F.coalesce(h["target"], F.lit("")))
    d = X.computed(d, _repeats=gates.history_flags(c("question"), body, c("answer_norm"), asked, targets))
    softer = "current_answer_repeated_in_history"
    unseen = F.when((c("prompt") != "") & ~gates.visible(texts, c("prompt")), "evidence_not_in_rendered_prompt")
    hard = F.concat("audit_flags", F.filter("_repeats", lambda f: f != softer), F.array_compact(F.array(unseen)))
    d = X.computed(d, _hard=F.array_sort(F.array_distinct(hard)), _soft=F.array_sort(F.array_distinct(F.concat("semantic_audit_flags", F.filter("_repeats", lambda f: f == softer)))))
    d = d.drop("audit_flags", "semantic_audit_flags", "quality_tier", "_repeats").withColumnsRenamed({"_hard": "audit_flags", "_soft": "semantic_audit_flags"})
    return d.withColumn("quality_tier", C.tier(F.concat("audit_flags", "semantic_audit_flags")))
