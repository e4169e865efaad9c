"""Filters and gates: each a boolean or a reason as a Column, or a check of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions.text import to_text
from .sampling import order_key


def listed(c: Column, names: str, default: str = "") -> Column:
    """Whether a value is in a list of names between commas (``default`` if the list is empty); any value
    passes where both are empty."""
    wanted = [x.strip() for x in (names or default).split(",") if x.strip()]
    return c.isin(*wanted) if wanted else F.lit(True)


def of_phase(df: DataFrame, manifest: DataFrame, keys: list[str], phase: str) -> DataFrame:
    """Rows whose key the manifest has in a phase."""
    return df.join(manifest.where(F.col("phase") == phase).select(*keys), keys, "left_semi")


def missing_fields(fields: list[str]) -> Column:
    """``missing_`` and the names of the empty fields; null if none is empty."""
    none = F.array_compact(F.array(*(F.when(to_text(F.col(f)) == "", F.lit(f)) for f in fields)))
    return F.when(F.size(none) > 0, F.concat(F.lit("missing_"), F.array_join(none, ",")))


def train_reason(fields: list[str], response: Column, gold: Column) -> Column:
    """Why a training row is unusable, null if it isn't: an empty field, a forbidden marker in its response, or
    ``gold``, the reason against its gold program."""
    return F.coalesce(missing_fields(fields), F.when(C.has_any(to_text(response), *C.MARKERS), "forbidden_reference_marker"), gold)


def target_reason(target: Column, canonical: Column, executed: Column) -> Column:
    """Why a response can't be a training target, null if it can: the first of six reasons. ``canonical`` is
    its program, ``executed`` struct<value, error>."""
    text = to_text(target)
    programs = (F.length(text) - F.length(F.replace(text, F.lit("Program:"), F.lit("")))) / len("Program:")
    return (
        F.when(C.has_any(text, *C.MARKERS), "forbidden_marker").when(programs > 1, "multiple_program").when(X.program_section(text) == "", "missing_program")
        .when(F.coalesce(canonical, F.lit("")) == "", "parse_failed").when(executed["error"].isNotNull(), "execution_failed").when(executed["value"].isNull(), "execution_none")
    )


def history_flags(question: Column, target: Column, answer: Column, questions: Column, targets: Column) -> Column:
    """What a record repeats of its history (arrays of questions and targets), texts compared without case and
    punctuation: the question, the whole target, or an answer line."""
    history = X.comparable_question(F.concat_ws(" ", questions, targets))

    def found(h: Column) -> Column:
        inside = lambda c: (X.comparable_question(c) != "") & F.contains(h, X.comparable_question(c))
        line = F.concat(F.lit("Answer: "), to_text(answer))
        repeated = (to_text(answer) != "") & F.exists(targets, lambda t: F.contains(to_text(t), line))
        return F.array_compact(F.array(F.when(inside(question), "duplicate_current_question_in_history"), F.when(inside(target), "current_target_leaked_in_history"), F.when(repeated, "current_answer_repeated_in_history")))

    return F.when(F.size(questions) > 0, X.bind(history, found)).otherwise(F.array().cast("array<string>"))


def visible(evidence: Column, prompt: Column) -> Column:
    """Whether a prompt's report shows all evidence texts, white space and case aside; false without evidence."""
    plain = lambda c: F.lower(X.normalize_ws(c))
    return F.coalesce((F.size(evidence) > 0) & X.bind(plain(X.report_context(prompt)), lambda r: F.forall(evidence, lambda e: F.contains(r, plain(e)))), F.lit(False))


def preference_ok(chosen: Column, rejected: Column, correct_samples: Column, *, least: int = 0, programs: tuple[bool, bool] = (True, False), answers: tuple[bool, bool] = (False, False)) -> Column:
    """Whether a pair passes: enough right samples, a program where one is asked for (chosen, rejected), and no
    answer line where it isn't allowed."""
    ok = F.coalesce(correct_samples, F.lit(0)) >= least
    for c, program, answer in zip((to_text(chosen), to_text(rejected)), programs, answers, strict=True):
        ok = ok & (c.contains("Program:") | F.lit(not program)) & (~c.rlike(r"(?:^|\n)Answer:") | F.lit(answer))
    return ok


def within(lengths: dict[str, tuple[Column, int]]) -> Column:
    """Every length is in (0, most]."""
    out = F.lit(True)
    for n, most in lengths.values():
        out = out & (n > 0) & (n <= most)
    return out


def require_same(df: DataFrame, config: str) -> DataFrame:
    """``df``, or a failure where its rows have several configurations. One aggregate row decides."""
    seen = df.agg(F.min(config).alias("_a"), F.max(config).alias("_b"))
    checked = seen.select(F.assert_true(F.col("_a").eqNullSafe(F.col("_b")), F.concat(F.lit("scoring configurations differ: "), F.col("_a"), F.lit(" and "), F.col("_b"))).alias("_ok"))
    return df.join(F.broadcast(checked)).where("_ok is null").drop("_ok")  # one row


#: Conclusions of a quality gate.
REACQUIRE, INSUFFICIENT, ALLOWED = "reacquisition_required", "diversity_insufficient", "probe_allowed"


def gate(checks: dict[str, Column], blocking: str) -> Column:
    """struct<failed, allowed, conclusion>: names of the checks that fail, in order; the check ``blocking``
    decides alone where it fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    code = F.when(F.array_contains(failed, blocking), REACQUIRE).when(F.size(failed) > 0, INSUFFICIENT).otherwise(ALLOWED)
    return F.struct(failed.alias("failed"), (F.size(failed) == 0).alias("allowed"), code.alias("conclusion"))


#: Bounds of a frontier's quality gate: (least, most), either may be None.
BOUNDS = {
    "leakage": (None, 0), "records": (64, None), "train_rows": (56, None), "valid_rows": (8, None), "executable_contrast_ratio": (0.8, None), "mixed_reward_ratio": (0.6, None),
    "duplicate_collapse_ratio": (None, 0.4), "mean_executable_program_unique_ratio": (0.25, None), "executable_rate": (0.7, None), "direct_lookup_share": (None, 0.4),
    "top1_skeleton_share": (None, 0.4), "history_rows": (1, None), "nonhistory_rows": (1, None), "families": (3, None), "prompt_mismatches": (None, 0),
}


def quality_gate(summary: DataFrame, bounds: dict = BOUNDS, blocking: str = "prompt_mismatches") -> DataFrame:
    """A one-row summary with ``decision`` by the bounds on its columns."""
    check = lambda c, low, high: (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))
    return summary.withColumn("decision", gate({c: check(c, *b) for c, b in bounds.items()}, blocking))


def bucket_rows(df: DataFrame, wants: dict[str, tuple[Column, int]], seed: int, *ids: str) -> DataFrame:
    """As many rows of each bucket (condition, rows) as are wanted, at random; a bucket with fewer fails."""
    out = None
    for name, (cond, n) in wants.items():
        part = df.where(cond).orderBy(order_key(seed, *(F.col(c) for c in ids)), *ids).limit(n).withColumn("bucket", F.lit(name))
        have = part.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") == n, F.lit(f"bucket {name} has fewer than {n} rows")).alias("_ok"))
        part = part.join(F.broadcast(have)).where("_ok is null").drop("_ok")  # one row
        out = part if out is None else out.unionByName(part)
    return out
