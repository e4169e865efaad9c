"""Scores and rewards of completions, as arithmetic over Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import program as P
from .numbers import parse_plain
from .text import bind, to_text, word_count


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean; weights below 0 count as 0, without any the result is 0."""
    total = sum(max(0.0, w) for w in weights.values())
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(max(0.0, w)) * scores[name]
    return out / F.lit(total) if total > 0 else F.lit(0.0)


# Weights of a semantic process score.
SEMANTIC = {"process": 0.24, "source": 0.14, "scale": 0.14, "no_extra": 0.16, "ratio_divide": 0.12, "denominator": 0.1, "table": 0.06, "lookup": 0.04}


def semantic_process(s: dict[str, Column]) -> Column:
    """From process, source, scale, extra, ratio_divide, denominator, table, lookup, strict and shortcut: the
    weighted sum, held in [0, 1] after it is scaled by strictness and by the least of its gates."""
    parts = s | {"no_extra": 1.0 - s["extra"]}
    gate = F.least(s["ratio_divide"], s["denominator"], s["lookup"], 1.0 - s["shortcut"])
    total = sum((F.lit(w) * parts[n] for n, w in SEMANTIC.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * s["strict"] * gate))


def length_shape(c: Column, low: int = 80, high: int = 160, cap: int = 220) -> Column:
    """1 for a text of ``low`` to ``high`` words, less in proportion on either side, 0 without words or beyond ``cap``."""
    return bind(word_count(c), lambda n: F.when((n == 0) | (n > cap), 0.0).otherwise(F.least(F.lit(1.0), n / F.lit(float(low)), 1.0 - (n - high) / F.lit(float(max(cap - high, 1))))))


def length_penalty(c: Column, target: int, weight: float, most: float) -> Column:
    """How far a text is over its target length, weighted, ``most`` at most; 0 if any parameter is off."""
    if min(target, weight, most) <= 0:
        return F.lit(0.0)
    over = F.greatest(F.length(to_text(c)) - target, F.lit(0)) / F.lit(float(target))
    return F.least(F.lit(most), over * F.lit(weight))


def denominator_grounding(program: Column, evidence: Column) -> Column:
    """The share of a program's denominators that the evidence has; 1 without divisions."""
    return denominator_share(P.denominators(program), P.arguments(evidence))


def denominator_share(d: Column, seen: Column) -> Column:
    """``denominator_grounding`` of denominators and numbers of the evidence that are columns already."""
    found = F.when(F.size(F.array_distinct(d)) == F.size(d), F.size(F.array_intersect(d, seen))).otherwise(F.size(F.filter(d, lambda x: F.array_contains(seen, x))))
    return F.when(F.size(d) == 0, 1.0).otherwise(found / F.greatest(F.size(d), F.lit(1)))


def source_precision(program: Column, evidence: Column) -> Column:
    """F1 of the program's and the evidence's distinct numbers."""
    distinct = lambda c: F.array_distinct(P.arguments(c))
    return P.multiset_f1(distinct(program), distinct(evidence))


def extra_numbers(program: Column, evidence: Column) -> Column:
    """The share of a program's distinct numbers that the evidence lacks; 0 without numbers."""
    return F.lit(1.0) - P.grounding(program, evidence)


# Words of a question that call for a division.
RATIO_WORDS = ("percent", "percentage", "ratio", "margin", "rate", "portion", "share of")


def ratio_divides(question: Column, program: Column) -> Column:
    """0 where a question asks for a ratio and the program has no division, else 1."""
    from .classify import has_any

    return F.when(has_any(F.lower(to_text(question)), *RATIO_WORDS) & ~F.array_contains(P.ops(program), "divide"), 0.0).otherwise(1.0)


def lookup_shortcut(question_type: Column, program: Column) -> Column:
    """0 where a question that isn't a lookup is answered by a program without operators, else 1."""
    return F.when((question_type != "direct_lookup") & (F.size(P.ops(program)) == 0), 0.0).otherwise(1.0)


def operation_prior(question: Column, program: Column, wants: dict[str, tuple[str, ...]]) -> Column:
    """The share of the operators that the question's words call for (word -> operators) that the program has;
    1 if none is called for."""
    q = F.lower(to_text(question))
    asked = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(q.contains(w), F.array(*(F.lit(o) for o in ops)))  for w, ops in wants.items())))))
    return bind(asked, lambda a: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, P.ops(program))) / F.greatest(F.size(a), F.lit(1))))


def exact_reward(completion: Column, gold: Column) -> Column:
    """1 for the gold text in answer tags, or the whole text where there are none; white space aside."""
    from .text import tag

    said = F.coalesce(F.nullif(tag(completion, "answer"), F.lit("")), to_text(completion))
    return (said == to_text(gold)).cast("double")


def format_reward(completion: Column) -> Column:
    """1 for a text that is a thought and an answer in their tags and nothing else."""
    return F.coalesce(completion.rlike(r"(?s)\A\s*<think>.*?</think>\s*<answer>.*?</answer>\s*\z"), F.lit(False)).cast("double")


def section_reward(completion: Column, anchors: tuple[str, ...]) -> Column:
    """The share of the anchors that a text has."""
    text = F.coalesce(completion, F.lit(""))
    return sum((F.contains(text, F.lit(a)).cast("int") for a in anchors), F.lit(0)) / F.lit(float(len(anchors)))


def plain_answer_reward(completion: Column, gold: Column, rel: float = 1e-4, abs_: float = 1e-4) -> Column:
    """1 for the first number within tolerance of the gold one, else for equal texts."""
    p, g = parse_plain(completion), parse_plain(gold)
    near = F.abs(p - g) <= F.greatest(F.lit(abs_), F.abs(g) * F.lit(rel))
    return F.when(p.isNotNull() & g.isNotNull(), near).otherwise(to_text(completion) == to_text(gold)).cast("double")


# The parts of a reward set and what each is worth at most.
PARTS = {"answer": 0.55, "format": 0.18, "runs": 0.08, "operators": 0.12, "consistent": 0.1, "evidence": 0.05, "brief": 0.05}
FORBIDDEN_COST, BRIEF_WORDS = 0.15, (8, 120)


def reward_set(completion: Column, program: Column, value: Column, gold_value: Column, gold_program: Column, prompt: Column, required: tuple[str, ...], forbidden: tuple[str, ...]) -> Column:
    """struct of the parts: the answer the program gives, sections there and not there, a program that runs, the
    share of the gold operators it has, its agreement with the answer, evidence numbers of the prompt, length."""
    from .numbers import close
    from .text import evidence_section

    text = F.coalesce(completion, F.lit(""))
    right = F.coalesce(close(value, gold_value), F.lit(False)).cast("double")
    worth = {n: F.lit(w) for n, w in PARTS.items()}
    unwanted = F.lit(float(len(forbidden))) * section_reward(text, forbidden) if forbidden else F.lit(0.0)
    has = to_text(program) != ""
    gold = F.array_distinct(P.ops(gold_program))
    operators = F.when(has & (F.size(gold) > 0), F.size(F.array_intersect(gold, P.ops(program))) / F.greatest(F.size(gold), F.lit(1))).otherwise(0.0)
    words = word_count(text)
    return F.struct(
        (worth["answer"] * right).alias("answer"),
        F.greatest(F.lit(0.0), worth["format"] * section_reward(text, required) - F.lit(FORBIDDEN_COST) * unwanted).alias("format"),
        F.when(has & value.isNotNull(), worth["runs"]).otherwise(0.0).alias("runs"),
        (worth["operators"] * operators).alias("operators"),
        (worth["consistent"] * right).alias("consistent"),
        F.when(F.arrays_overlap(P.arguments(evidence_section(text)), P.arguments(prompt)), worth["evidence"]).otherwise(0.0).alias("evidence"),
        F.when(words.between(*BRIEF_WORDS), worth["brief"]).otherwise(0.0).alias("brief"),
    )


def completion_reward(*, exact: Column, executable: Column, closeness: Column, structure: Column, coverage: Column, steps: Column, semantic: Column, format_penalty: Column, length_penalty_: Column,
                      base: float = 1.0, weights: tuple[float, float, float] = (0.05, 0.03, 0.02), cap: float = 0.2, floor: float = 0.5, semantic_weight: float = 0.1) -> Column:
    """The reward of a program completion: 0 if it didn't run. A right one has ``base`` and a little for its
    likeness to the gold program, less penalties, ``floor`` at least. A wrong one has ``cap`` times its
    closeness, less penalties and what its semantic score lacks, within 0 and ``cap``."""
    likeness = sum((F.lit(w) * c for w, c in zip(weights, (structure, coverage, steps), strict=True)), F.lit(base))
    penalty = format_penalty + length_penalty_
    wrong = F.lit(cap) * closeness - F.lit(semantic_weight) * (1.0 - semantic) - penalty
    return F.when(~executable, 0.0).when(exact, F.greatest(F.lit(floor), likeness - penalty)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), wrong)))


# Reward of an invalid completion, weights of the process score, of likeness by whether outcome comes first, what answer lines add and cost by mode.
INVALID = -1.0
PROCESS = {"evidence_alignment": 0.04, "argument_precision": 0.04, "operation_prior": 0.03, "dsl": 0.01, "ratio_divide": 0.0, "denominator": 0.0, "table": 0.0, "lookup": 0.0}
LIKENESS = {False: (0.05, 0.03, 0.02), True: (0.03, 0.02, 0.01)}
ANSWER_FIRST = {"program": 0.15, "consistent": 0.05, "no_dsl": 0.12, "floor": 0.55}
CALIBRATION = {(True, True): 0.25, (True, False): 1.0, (False, True): -0.3, (False, False): -0.1}
AUX = {"answer": 0.06, "consistent": 0.04, "missing": 0.05, "inconsistent": 0.15, "wrong": 0.01}
GATED = {"answer": 0.03, "consistent": 0.05, "missing": 0.04, "most": 0.25}
DENSE = {"trailing": 0.04, "infix": 0.06, "wrapper": 0.06, "scale": 0.04}
PLAIN = {"forbidden": 0.05, "multiple": 0.05, "trailing": 0.05}
DENSE_LEAST, DENSE_MOST = 0.02, 0.35

#: Modes of ``program_reward``.
MODES = ("execution", "answer_only", "answer_first", "frontier_execution_calibration", "program_first_answer_aux", "program_gated_answer_aux")


@dataclass(frozen=True)
class RewardSettings:
    """How completions are rewarded; the defaults are fixed values."""

    mode: str = "execution"
    outcome_first: bool = False
    dense: bool = False
    hard_gate: bool = False
    process: bool = False
    process_weight: float = 0.12
    brevity_weight: float = 0.02
    floor: float = 0.85
    wrong_cap: float = 0.2
    invalid: float = INVALID
    soft_weight: float = 0.05
    soft_most: float = 0.15
    semantic_weight: float = 0.0
    history_weight: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {', '.join(MODES)}")


def process_score(scores: dict[str, Column], weights: dict[str, float] = PROCESS) -> Column:
    """How a program came about, in [0, 1]: the weighted mean of the scores named in ``weights``."""
    return weighted(scores, weights)


def program_reward(parts: dict[str, Column], settings: RewardSettings = RewardSettings()) -> Column:
    """The reward of a program completion in one of six modes.

    Numbers: answer_only, answer_first, structure, coverage, steps, closeness, semantic, process, scale, brevity, history (scores), schema_reasons and contract_reasons
    (counts), length_penalty, reasoning_penalty. Booleans: runs, exact, dsl (strictly valid), answered (it names a number), consistent (that the program gives),
    forbidden, multiple, trailing, answer_line, infix, wrapper, history_due. What is missing or null counts as 0 or false, but scale and history as 1."""
    s = settings
    ones = {"scale": 1.0, "history": 1.0}
    n = lambda k: F.coalesce(parts[k].cast("double"), F.lit(ones.get(k, 0.0))) if k in parts else F.lit(ones.get(k, 0.0))
    is_ = lambda k: n(k) > 0
    aux, gated = s.mode == "program_first_answer_aux", s.mode == "program_gated_answer_aux"
    if s.mode == "answer_only":
        return n("answer_only")
    soft = sum((F.least(F.lit(s.soft_most), F.lit(s.soft_weight) * n(k)) for k in ("schema_reasons", "contract_reasons")), F.lit(0.0))
    lengths = n("length_penalty") + n("reasoning_penalty")
    if s.mode == "answer_first":
        worth = 1.0 + F.lit(ANSWER_FIRST["program"]) * n("exact") + F.lit(ANSWER_FIRST["consistent"]) * n("consistent")
        cost = soft + F.when(is_("dsl"), 0.0).otherwise(ANSWER_FIRST["no_dsl"]) + lengths
        return F.when(is_("answer_first"), F.greatest(F.lit(ANSWER_FIRST["floor"]), worth - cost)).otherwise(0.0)
    violated = n("schema_reasons") + n("contract_reasons") > 0
    invalid = F.lit(s.invalid if s.outcome_first else INVALID)
    if s.mode == "frontier_execution_calibration":
        bad = violated | ~is_("dsl")
        score = lambda right: F.when(bad, CALIBRATION[right, True]).otherwise(CALIBRATION[right, False])
        return F.when(~is_("runs"), invalid).when(is_("exact"), score(True)).otherwise(score(False))

    trailing = is_("trailing") & ~is_("answer_line") if aux or gated else is_("trailing")
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    if s.dense:
        format_ = soft + flag(trailing, DENSE["trailing"]) + flag(is_("infix"), DENSE["infix"]) + flag(is_("wrapper"), DENSE["wrapper"]) + F.lit(DENSE["scale"]) * (1.0 - F.least(n("scale"), F.lit(1.0)))
    elif s.outcome_first:
        format_ = soft
    else:
        format_ = sum((flag(is_(k), w) for k, w in PLAIN.items()), F.lit(0.0))
    process = F.lit(s.process_weight) * n("process") if s.process else F.lit(0.0)

    right = sum((F.lit(w) * n(k) for k, w in zip(("structure", "coverage", "steps"), LIKENESS[s.outcome_first], strict=True)), F.lit(1.0)) + F.lit(s.brevity_weight) * n("brevity") + process
    clash = is_("answered") & ~is_("consistent")
    if aux:
        right = right + F.lit(AUX["answer"]) * n("answer_first") + F.lit(AUX["consistent"]) * n("consistent") - F.when(~is_("answered"), AUX["missing"]).when(clash, AUX["inconsistent"]).otherwise(0.0)
    if gated:
        agreed = right + F.lit(GATED["answer"]) * n("answer_first") + F.lit(GATED["consistent"]) * n("consistent")
        right = F.when(~is_("answered"), right - GATED["missing"]).when(clash, F.least(right, F.lit(GATED["most"]))).otherwise(agreed)
    right = F.greatest(F.lit(s.floor), right - format_ - lengths)
    if gated:
        right = F.when(clash, F.least(right, F.lit(GATED["most"]))).otherwise(right)
    if s.dense:
        right = F.when(is_("infix") | trailing | is_("wrapper"), F.least(right, 1.0 - F.least(F.lit(DENSE_MOST), F.greatest(F.lit(DENSE_LEAST), format_)))).otherwise(right)
    right = F.when(is_("history_due") & (n("history") < 1.0), F.least(right, 1.0 - F.lit(s.history_weight) * (1.0 - n("history")))).otherwise(right)

    wrong = F.lit(s.wrong_cap) * n("closeness") - process + (F.lit(AUX["wrong"]) * n("answer_first") if aux else F.lit(0.0))
    wrong = F.least(F.lit(s.wrong_cap), F.greatest(F.lit(0.0), wrong - F.lit(s.semantic_weight) * (1.0 - n("semantic")) - format_ - lengths))
    open_ = is_("runs") if not s.hard_gate or s.outcome_first else is_("runs") & ~violated
    return F.when(~open_, invalid).when(is_("exact"), right).otherwise(wrong)


def sequence_reward(scores: dict[str, Column], weights: dict[str, float], bonus: Column, penalty: Column) -> Column:
    """The sequence-level variant: a weighted core in [0, 1], a bonus for short answers and a penalty."""
    return F.greatest(F.lit(0.0), weighted(scores, weights) + bonus - penalty)


# What each finding adds to a candidate's quality, and the length beyond which it loses.
QUALITY = {"answer_correct": 4.0, "format_ok": 1.5, "has_answer": 0.5, "program_consistent": 1.0}
HIT_COST, MOST_HIT_COST, LONG_RESPONSE = 0.5, 2.0, 1400


def quality(findings: dict[str, Column], hits: Column, rubric_total: Column, chars: Column) -> Column:
    """A candidate's quality, 6 decimals: findings, half the rubric's total, less hits and length."""
    out = rubric_total / F.lit(2.0) - F.least(F.lit(MOST_HIT_COST), hits * F.lit(HIT_COST)) - F.greatest(chars - LONG_RESPONSE, F.lit(0)) / F.lit(float(LONG_RESPONSE))
    for name, worth in QUALITY.items():
        out = out + F.when(F.coalesce(findings[name], F.lit(False)), worth).otherwise(0.0)
    return F.round(out, 6)


def rubric(fields: dict[str, tuple[Column, Column]]) -> Column:
    """struct of fields of 0, 1 or 2 and their ``total``. Each is given by the conditions for 2 and for 1."""
    score = {n: F.when(F.coalesce(two, F.lit(False)), 2).when(F.coalesce(one, F.lit(False)), 1).otherwise(0) for n, (two, one) in fields.items()}
    return F.struct(*(c.alias(n) for n, c in score.items()), sum(score.values(), F.lit(0)).alias("total"))
