"""Operators over conversations, array<struct<from, value>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, tag, to_text

TURNS = "array<struct<`from`:string,value:string>>"
#: Other names of the two roles.
ROLES = {"user": "human", "human": "human", "assistant": "gpt", "gpt": "gpt", "model": "gpt", "system": "system"}


def role(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.lower(c))


def fold(turns: DataFrame, key: str = "conv_id", order: str = "turn", who: str = "role", text: str = "text") -> DataFrame:
    """(key, conversations) of turn rows, in order."""
    t = F.struct(F.col(order).alias("o"), role(F.col(who)).alias("from"), F.col(text).alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(t)), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return turns.groupBy(key).agg(ordered.alias("conversations"))


def clean_reason(c: Column, *, chars: int = 2000, total: int = 4000, least: int = 2, most: int = 20, drop_odd: bool = True, keep_long: bool = False) -> Column:
    """The first rule that a conversation breaks, null if it breaks none. Turns are judged one by one,
    each by validity, role order and length; the first bad turn decides."""

    def bad(x: Column, i: Column) -> Column:
        value = strip(x["value"])
        valid = x["from"].isin("human", "gpt") & (value != "")
        expected = F.when(i % 2 == 0, "human").otherwise("gpt")
        return F.when(~F.coalesce(valid, F.lit(False)), "drop_invalid_turn").when(x["from"] != expected, "drop_role_order").when(F.length(value) > chars, "drop_overlong_turn")

    first = F.try_element_at(F.filter(F.transform(c, bad), lambda r: r.isNotNull()), F.lit(1))
    n = F.size(c)
    length = F.aggregate(c, F.lit(0), lambda s, x: s + F.length(strip(x["value"])))
    long = F.lit(not keep_long)
    return (
        F.when(c.isNull() | (n == 0), "drop_missing_conversations")
        .when(first.isNotNull(), first)
        .when(n < least, "drop_too_few_turns")
        .when(F.lit(drop_odd) & (n % 2 != 0), "drop_odd_turns")
        .when(long & (n > most), "drop_too_many_turns")
        .when(long & (length > total), "drop_overlong_sample")
    )


def total_chars(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda s, x: s + F.length(strip(x["value"])))


def first_of(c: Column, who: str) -> Column:
    """The first message of a role, by any of its names."""
    found = F.filter(c, lambda x: role(x["from"]) == who)
    return to_text(F.try_element_at(found, F.lit(1))["value"])


def audit_reasons(human: Column, gpt: Column, conflict: Column, *, short: int = 40, long_prompt: int = 1200, ratio: float = 0.02) -> Column:
    """Reasons to look at a sample, in a fixed order."""
    h, g = F.length(human), F.length(gpt)
    few = g < short
    return F.array_compact(
        F.array(
            F.when(few, "short_answer"),
            F.when((h > long_prompt) & few, "long_prompt_short_answer"),
            F.when(g / F.greatest(h, F.lit(1)) < ratio, "very_low_answer_prompt_ratio"),
            F.when(gpt.rlike(r"(?i)evidence\s*(?:text)?_?\d*\s*placeholder|text_1\b"), "evidence_placeholder_text_1"),
            F.when(gpt.rlike(r"\bconst_"), "contains_const_placeholder"),
            F.when(conflict, "same_prompt_conflicting_labels"),
        )
    )


def severity(reasons: Column) -> Column:
    high = F.array(*(F.lit(x) for x in ("long_prompt_short_answer", "evidence_placeholder_text_1", "same_prompt_conflicting_labels")))
    return F.when(F.size(reasons) == 0, F.lit(None)).when(F.arrays_overlap(reasons, high), "high").otherwise("medium")


def audit_decision(reasons: Column, mode: str = "strict") -> Column:
    """Whether a sample stays: strict keeps only samples without reasons, conservative drops conflicts and
    placeholders alone."""
    if mode == "strict":
        return F.size(reasons) == 0
    drop = F.array(*(F.lit(x) for x in ("evidence_placeholder_text_1", "same_prompt_conflicting_labels", "long_prompt_short_answer")))
    return ~F.arrays_overlap(reasons, drop)


def rewrite_answers(c: Column, mode: str = "answer_only") -> Column:
    """Assistant turns as their answer, with or without its tag, or as they are; null if one has no answer."""

    def one(x: Column) -> Column:
        answer = tag(x["value"], "answer")
        body = {"answer_only": answer, "answer_with_tag": F.concat(F.lit("<answer>\n"), answer, F.lit("\n</answer>"))}.get(mode, strip(x["value"]))
        value = F.when(x["from"] != "gpt", strip(x["value"])).when(answer != "", body)
        return F.struct(x["from"].alias("from"), value.alias("value"))

    out = F.transform(c, one)
    return F.when(F.forall(out, lambda x: x["value"].isNotNull()), out)


def dpo_reason(question: Column, chosen: Column, rejected: Column, history: Column | None = None, anchors: tuple[str, ...] = ("Evidence:", "Program:", "Answer:")) -> Column:
    """Why a preference pair is dropped, null if it isn't."""
    q, c, r = to_text(question), to_text(chosen), to_text(rejected)
    has = F.array_compact(F.array(*(F.when(c.contains(a), F.lit(a)) for a in anchors)))
    missing = F.lit(False) if history is None else history.isNull()
    return (
        F.when(missing, "invalid_history_type")
        .when(q == "", "empty_question")
        .when(c == "", "empty_chosen")
        .when(r == "", "empty_rejected")
        .when(c == r, "identical_pair")
        .when(F.length(r) < F.greatest(F.lit(24), F.floor(F.length(c) * F.lit(0.2))), "rejected_too_short")
        .when((F.size(has) > 0) & ~F.exists(has, lambda a: r.contains(a)), "not_comparable")
    )


def distilled_dpo_reason(question: Column, chosen: Column, rejected: Column, least: int = 8) -> Column:
    q, c, r = to_text(question), to_text(chosen), to_text(rejected)
    return (
        F.when((q == "") | (c == "") | (r == ""), "drop_missing_required_field")
        .when(F.length(q) < least, "drop_short_question")
        .when((tag(c, "answer") == "") | (tag(r, "answer") == ""), "drop_missing_answer_tag")
        .when(c == r, "drop_same_responses")
    )


def pairs(df: DataFrame, key: str, conversations: str = "conversations") -> DataFrame:
    """(key, at, human, gpt): each gpt turn with the latest human turn before it."""
    turns = F.col(conversations)
    index = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.element_at(turns, i)["from"] == "gpt")

    def one(i: Column) -> Column:
        before = F.filter(F.slice(turns, 1, i - 1), lambda x: x["from"] == "human")
        return F.struct(i.alias("at"), F.try_element_at(before, F.lit(-1))["value"].alias("human"), F.element_at(turns, i)["value"].alias("gpt"))

    return df.where(F.size(turns) > 0).select(key, F.inline(F.transform(index, one))).where("human is not null")


def prompts(df: DataFrame, key: str, conversations: str = "conversations") -> DataFrame:
    """(key, at, prompt, answer): every turn's prompt, all before it in one text; dialogs of bad role order
    or odd length are left out."""
    turns = F.col(conversations)
    ok = (F.size(turns) % 2 == 0) & F.forall(F.transform(turns, lambda x, i: x["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda x: x)
    line = lambda x: F.concat(x["from"], F.lit(": "), x["value"])
    made = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: i % 2 == 1),
        lambda i: F.struct(i.alias("at"), F.array_join(F.transform(F.slice(turns, 1, i), line), "\n").alias("prompt"), F.element_at(turns, i + 1)["value"].alias("answer")),
    )
    return df.where((F.size(turns) > 0) & ok).select(key, F.inline(made))


def sharegpt(human: Column, gpt: Column) -> Column:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return F.array(turn("human", human), turn("gpt", gpt))


def chat(system: Column | None, prompt: Column) -> Column:
    """array<struct<role, content>> for a chat template."""
    m = lambda who, c: F.struct(F.lit(who).alias("role"), c.alias("content"))
    return F.array(m("system", system), m("user", prompt)) if system is not None else F.array(m("user", prompt))


#: Named layouts of a dialog: system prefix, turn layout and separator between turns.
TEMPLATES = {
    "plain": ("{system}", "User: {q}\nAssistant: {a}", "\n"),
    "vicuna": ("{system} ", "USER: {q} ASSISTANT: {a}", "</s>"),
    "chatml": ("<|im_start|>system\n{system}<|im_end|>\n", "<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\n{a}", "<|im_end|>\n"),
    "llama2": ("<<SYS>>\n{system}\n<</SYS>>\n\n", "[INST] {q} [/INST] {a}", "</s>"),
    "alpaca": ("{system}\n\n", "### Instruction:\n{q}\n\n### Response:\n{a}", "\n\n"),
}


def register_template(name: str, system: str, turn: str, separator: str) -> None:
    """A later registration of a name wins."""
    TEMPLATES[name] = (system, turn, separator)


def render_dialog(pairs_: Column, system: str, template: str = "plain") -> Column:
    """A dialog, array<struct<human, gpt>>, in a named layout."""
    head, turn, sep = TEMPLATES[template]
    one = lambda x: F.replace(F.replace(F.lit(turn), F.lit("{q}"), x["human"]), F.lit("{a}"), F.coalesce(x["gpt"], F.lit("")))
    return F.concat(F.lit(head.replace("{system}", system) if system else ""), F.array_join(F.transform(pairs_, one), sep))


SCHEMA = T.StructType([T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))])
