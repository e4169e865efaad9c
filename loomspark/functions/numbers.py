"""The number parsers and tolerance predicates. Each consumer has its own; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, display_answer, normalized_answer, strip, to_text

# What counts as a number for each parser.
FIRST = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
LAST = r"-?\d[\d,]*(?:\.\d+)?%?"
WITH_DOLLAR = r"-?\$?\d[\d,]*(?:\.\d+)?%?"
WITH_EXPONENT = r"-?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?%?"


def _double(c: Column) -> Column:
    return c.try_cast("double")


def parse_first(c: Column) -> Column:
    """The first number: ``$`` and commas go, a text all in brackets is negative, a ``%`` right after divides by 100.

    Parts that recur are written out, since they are compiled and computed once then; bound ones are neither."""
    text = to_text(c)
    found = F.regexp_extract(F.translate(text, "$,", ""), f"({FIRST})(%?)", 0)
    n = _double(F.nullif(F.rtrim(found, F.lit("%")), F.lit("")))
    bracketed = text.endswith(")") & text.rlike(r"^\([^()]+\)$")
    return n * F.when(bracketed & (n > 0), -1.0).otherwise(1.0) / F.when(found.endswith("%"), 100.0).otherwise(1.0)


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(text, "，", ","), F.lit(f"({pattern})"), 1)
    token = F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")
    return bind(token, lambda t: _double(F.rtrim(t, F.lit("%"))) / F.when(t.endswith("%"), 100.0).otherwise(1.0))


def parse_answer(c: Column) -> Column:
    """The last number of the normalized answer, else the answer line, else the text."""
    section = F.coalesce(F.nullif(normalized_answer(c), F.lit("")), F.nullif(display_answer(c), F.lit("")), c)
    return _last(section, LAST)


def parse_distilled(c: Column) -> Column:
    return _last(c, WITH_DOLLAR)


def parse_reward(c: Column) -> Column:
    return _last(c, WITH_EXPONENT)


def parse_plain(c: Column) -> Column:
    """The first number; a percent sign is ignored."""
    return _double(F.regexp_replace(F.nullif(F.regexp_extract(c, f"({LAST})", 1), F.lit("")), "[,%]", ""))


def close(a: Column, b: Column, rel: float = 1e-4, abs_: float = 1e-4) -> Column:
    """Symmetric: within the larger of ``rel`` times the larger magnitude and ``abs_``."""
    near = lambda k: F.abs(k["a"] - k["b"]) <= F.greatest(F.lit(rel) * F.greatest(F.abs(k["a"]), F.abs(k["b"])), F.lit(abs_))
    return bind(F.struct(a.alias("a"), b.alias("b")), near)


def equivalent(a: Column, b: Column, percent: Column | None = None) -> Column:
    """Within 1e-4 of b, in absolute or relative terms. Where ``percent``, also a hundred times either
    side, and within 1.0 where either side is over 1. False if a side is null."""
    both = F.struct(a.alias("a"), b.alias("b"), (F.lit(False) if percent is None else percent).alias("p"))
    return bind(both, lambda k: equivalent_of(k["a"], k["b"], None if percent is None else k["p"]))


def equivalent_of(x: Column, y: Column, percent: Column | None = None) -> Column:
    """``equivalent`` of numbers that are columns already."""

    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) <= F.greatest(F.lit(1e-4), F.abs(y) * F.lit(1e-4))

    out = near(x, y)
    if percent is not None:
        slack = lambda u, v: (F.abs(u - v) <= 1.0) & ((F.abs(u) > 1.0) | (F.abs(v) > 1.0))
        h = F.lit(100.0)
        out = out | (percent & (slack(x, y) | near(x * h, y) | slack(x * h, y) | near(x, y * h) | slack(x, y * h)))
    return F.coalesce(out, F.lit(False))


def numeric_equal(pred: Column, gold: Column, rel: float = 1e-4, abs_: float = 1e-4) -> Column:
    """Numbers within tolerance of the gold one; texts equal without regard to case."""
    p, g = parse_reward(pred), parse_reward(gold)
    near = F.abs(p - g) <= F.greatest(F.lit(abs_), F.abs(g) * F.lit(rel))
    return F.when(p.isNotNull() & g.isNotNull(), near).otherwise(F.lower(strip(pred)) == F.lower(strip(gold)))


def answer_correct(pred: Column, gold: Column, rel: float = 1e-4, abs_: float = 1e-4) -> Column:
    p, g = parse_plain(pred), parse_plain(gold)
    near = F.abs(p - g) <= F.greatest(F.lit(abs_), F.abs(g) * F.lit(rel))
    return F.when(p.isNotNull() & g.isNotNull(), near).otherwise(strip(pred) == strip(gold))


def show(c: Column, decimals: int = 6) -> Column:
    """An integer without a point, any other number with ``decimals`` places, zeros at the end left out."""
    fixed = lambda x: F.regexp_replace(F.format_string(f"%.{decimals}f", x), r"\.?0+$", "")
    return bind(c, lambda x: F.when(x.isNull(), F.lit("")).when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(fixed(x)))


def number_tokens(c: Column) -> Column:
    """Distinct numbers of a text in order, commas left out."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({FIRST})"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "")))


def _least_form(c: Column) -> Column:
    """A number without sign, zeros in front and zeros after its decimals."""
    short = F.regexp_replace(c, r"^-?0*+(?=\d)|(?<=\.\d{0,30})0+$", "")
    return F.when(c.contains("."), F.rtrim(short, F.lit("."))).otherwise(F.regexp_replace(c, r"^-?(?:0+(?=\d))?", ""))


def has_number(text: Column, token: Column) -> Column:
    """Whether a text holds a number token, whole, not as digits of a longer number; commas between thousands and zeros that change nothing aside."""
    return bind(seen_numbers(text), lambda s: sees(s, token_form(token)))


def seen_numbers(text: Column) -> Column:
    """struct<plain, forms> of a text: what ``sees`` looks for tokens in."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d),(?=\d{3}(?!\d))", "")
    return bind(plain, lambda p: F.struct(p.alias("plain"), F.transform(F.regexp_extract_all(p, F.lit(r"(\d+(?:\.\d+)?)"), 1), _least_form).alias("forms")))


def token_form(token: Column) -> Column:
    """struct<t, form, number> of a number token."""
    t = F.replace(token, F.lit(","), F.lit(""))
    return F.struct(t.alias("t"), _least_form(t).alias("form"), t.rlike(r"^-?\d+(?:\.\d+)?$").alias("number"))


def sees(seen: Column, token: Column) -> Column:
    """``has_number`` of a text's ``seen_numbers`` and a token's ``token_form``."""
    t, plain = token["t"], seen["plain"]
    number = F.array_contains(seen["forms"], token["form"]) & (~t.startswith("-") | plain.contains("-"))
    return (t != "") & F.when(token["number"], number).otherwise(F.contains(plain, t))


def answer_display(raw: Column, norm: Column, question: Column) -> Column:
    """The raw answer if it has a unit; a percentage if the question asks for one; else the normalized one."""
    text, n, q = to_text(raw), parse_first(norm), F.lower(to_text(question))
    unit = F.lower(text).rlike(r"%|\$|million|billion|thousand")
    percent = F.concat(show(F.bround(n * F.lit(100.0), 1), 1), F.lit("%"))
    return F.when((text != "") & unit, text).when(n.isNotNull() & q.rlike("percentage|percent|rate"), percent).otherwise(F.coalesce(F.nullif(to_text(norm), F.lit("")), text))


def unit_and_scale(*texts: Column) -> tuple[Column, Column]:
    t = F.lower(F.concat_ws(" ", *(to_text(x) for x in texts)))
    percent = t.rlike("%|percent|percentage|rate|growth")
    unit = F.when(percent, "percent").when(t.contains("$"), "currency").otherwise("number")
    scale = F.when(t.contains("billion"), "billion").when(t.contains("million"), "million").when(percent, "ratio").otherwise("absolute")
    return unit, scale


# How far a number is moved, at least, and to how many decimals; what stands in for a missing one.
MOVE, LEAST_MOVE, MOVE_DECIMALS, NO_NUMBER = 0.12, 1.0, 4, " 1"


def mutate_number(c: Column) -> Column:
    """The text with its first number moved away from 0."""
    cut = F.regexp_instr(c, F.lit(FIRST))
    token = F.regexp_extract(c, FIRST, 0)

    def moved(t: Column) -> Column:
        farther = lambda v: v + F.when(v < 0, -1.0).otherwise(1.0) * F.greatest(F.abs(v) * F.lit(MOVE), F.lit(LEAST_MOVE))
        return show(bind(_double(F.regexp_replace(t, ",", "")), farther), MOVE_DECIMALS)

    replaced = bind(token, lambda t: F.concat(F.left(c, cut - 1), moved(t), F.substr(c, cut + F.length(t))))
    return F.when(cut == 0, F.concat(c, F.lit(NO_NUMBER))).otherwise(replaced)


def percentile(values: Column, q: float) -> Column:
    """The linearly interpolated percentile of an array, null and NaN left out; null if none is left."""

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(min(max(q, 0.0), 1.0))
        low, high = F.element_at(v, F.floor(place).cast("int") + 1), F.element_at(v, F.ceil(place).cast("int") + 1)
        return F.when(F.size(v) > 0, low + (high - low) * (place - F.floor(place)))

    return bind(F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))), at)
