"""Equality of mathematical answers in LaTeX.

An answer is read into numbers: rational arithmetic is exact, roots and functions are taken in double precision, and letters are sampled, so that
two answers are equal if they agree at every sample, whatever their form. Lists, sets, tuples and intervals are equal part by part, sets in any order. What
can't be read is compared as text, white space aside. Only columns of texts go through Python, in Arrow batches; a batch depends on no other.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import boxed, computed, tag, to_text

#: Samples of every letter, tokens and depth beyond which an answer isn't read, bits of an exact power.
SAMPLES, MOST_TOKENS, MOST_DEPTH, MOST_BITS = 3, 2000, 60, 4096
#: Relative difference within which inexact values agree.
NEAR = 1e-9

# Commands that only shape the text, names of functions and of constants.
SHAPE = r"\\(?:left|right|displaystyle|,|;|!|:| |quad|qquad|mathrm|mathbf|mathit|big|Big|bigg|Bigg|limits)(?![a-zA-Z])"
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": lambda x: cmath.log(x) / math.log(10), "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan}
CONSTANTS = {"pi": math.pi, "infty": math.inf, "e": math.e}
TIMES, OVER = {"*", "cdot", "times"}, {"/", "div"}
TOKEN = re.compile(r"\\\{|\\\}|\\%|\\([a-zA-Z]+)|(\d+(?:,\d{3})+(?:\.\d+)?(?![\d,])|\d+\.\d+|\.\d+|\d+)|([a-zA-Z](?:_(?:\{\w+\}|\w))?)|(\S)")


class _Unread(Exception):
    pass


def _plain(text: str) -> str:
    text = re.sub(r"\\(?:text|textbf|mbox)\s*\{[^{}]*\}|\^\s*(?:\{\s*\\circ\s*\}|\\circ)|\\degree|\\\$|\$|~", " ", text)
    text = re.sub(SHAPE, " ", text).replace("{,}", "").replace("\\[", " ").replace("\\]", " ").replace("−", "-").strip().rstrip(".")
    return re.sub(r"\\[dt]frac", r"\\frac", text.rsplit("=", 1)[-1] if text.count("=") == 1 else text)


def _tokens(text: str) -> list[str]:
    out, depth = [], 0
    for m in TOKEN.finditer(text):
        command, number, _, _ = m.groups()
        t = command or m.group(0)
        depth += (t in ("(", "[", "\\{")) - (t in (")", "]", "\\}"))
        # within brackets a comma parts, outside it groups digits
        out += re.findall(r"\d+|,|\.\d+", t) if number and depth and "," in t else [t.replace(",", "") if number else t]
    if len(out) > MOST_TOKENS:
        raise _Unread
    return out


def _power(a, b):
    if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1:
        if (a.numerator.bit_length() + a.denominator.bit_length()) * abs(b.numerator) > MOST_BITS:
            return complex(float(a)) ** float(b)
        return a ** b.numerator
    return complex(a) ** complex(b)


class _Reader:
    """One answer at one sample: sums of products of powers, read from left to right."""

    def __init__(self, tokens: list[str], sample: int):
        self.t, self.i, self.sample, self.depth = tokens, 0, sample, 0

    def peek(self) -> str | None:
        return self.t[self.i] if self.i < len(self.t) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or (want is not None and t != want):
            raise _Unread
        self.i += 1
        return t

    def items(self, ends: tuple) -> list:
        out = []
        while self.peek() not in ends:
            if out:
                self.take(",")
            out.append(self.union())
        return out

    def union(self):
        parts = [self.sum()]
        while self.peek() == "cup":
            self.take()
            parts.append(self.sum())
        return parts[0] if len(parts) == 1 else ("union", parts)

    def sum(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise _Unread
        sign = -1 if self.peek() == "-" else 1
        if self.peek() in ("+", "-"):
            self.take()
        value = self.product()
        value = -_num(value) if sign < 0 else value
        while self.peek() in ("+", "-"):
            op = self.take()
            other = _num(self.product())
            value = _num(value) + other if op == "+" else _num(value) - other
        self.depth -= 1
        return value

    def product(self):
        value = self.power()
        while (t := self.peek()) is not None:
            if t in TIMES or t in OVER:
                self.take()
                other = _num(self.signed())
                value = _num(value) * other if t in TIMES else _num(value) / other
            elif t[0].isalnum() and t not in ("cup",) or t in ("(", "{"):
                value = _num(value) * _num(self.power())
            else:
                break
        return value

    def signed(self):
        if self.peek() == "-":
            self.take()
            return -_num(self.power())
        return self.power()

    def power(self):
        value = self.atom()
        while self.peek() in ("^", "\\%", "%", "!"):
            t = self.take()
            if t == "^":
                value = _power(_num(value), _num(self.argument(signed=True)))
            elif t == "!":
                n = _num(value)
                if not isinstance(n, Fraction) or n.denominator != 1 or not 0 <= n <= 170:
                    raise _Unread
                value = Fraction(math.factorial(n.numerator))
            else:
                value = _num(value) / 100
        return value

    def argument(self, signed: bool = False):
        """A group in braces, or the next digit, letter or command."""
        t = self.peek()
        if t == "{":
            return self.group("{", "}")
        if t and t[0].isdigit() and len(t) > 1:
            self.t[self.i : self.i + 1] = list(t)
        if signed and t == "-":
            self.take()
            return -_num(self.argument())
        return self.atom()

    def group(self, open_: str, close: str):
        self.take(open_)
        value = self.sum()
        self.take(close)
        return value

    def atom(self):
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            return Fraction(t)
        if t == "frac":
            top = _num(self.argument())
            return top / _num(self.argument())
        if t == "sqrt":
            n = self.group("[", "]") if self.peek() == "[" else Fraction(2)
            return _root(_num(self.argument()), _num(n))
        if t in FUNCTIONS:
            power = self.argument(signed=True) if self.peek() == "^" and self.take() else Fraction(1)
            return _power(FUNCTIONS[t](complex(_num(self.power()))), _num(power))
        if t in CONSTANTS:
            return CONSTANTS[t]
        if t == "{":
            self.i -= 1
            return self.group("{", "}")
        if t in ("(", "[", "\\{"):
            ends = {"(": (")", "]"), "[": ("]", ")"), "\\{": ("\\}",)}[t]
            items = self.items(ends)
            close = self.take()
            if t == "(" and close == ")" and len(items) == 1:
                return items[0]
            return ("set", items) if t == "\\{" else (t + close, items)
        if t == "|":
            value = self.sum()
            self.take("|")
            return abs(_num(value))
        if t in ("emptyset", "varnothing"):
            return ("set", [])
        if t[0].isalpha():
            # a letter's sample: a fraction between 1 and 3, from its name
            h = sum(ord(c) * 31**k for k, c in enumerate(t)) * 2654435761 + self.sample * 40503
            return Fraction(1009 + h % 1993, 997)
        raise _Unread


def _num(v):
    if isinstance(v, tuple):
        raise _Unread
    return v


def _root(a, n):
    if isinstance(a, Fraction) and isinstance(n, Fraction) and n == 2 and a >= 0:
        p, q = math.isqrt(a.numerator), math.isqrt(a.denominator)
        if p * p == a.numerator and q * q == a.denominator:
            return Fraction(p, q)
    if isinstance(a, Fraction) and a < 0 and isinstance(n, Fraction) and n.denominator == 1 and n.numerator % 2:
        return -(complex(float(-a)) ** (1 / float(n)))
    return complex(a) ** (1 / complex(n))


def _read(text: str, sample: int):
    r = _Reader(_tokens(text), sample)
    items = r.items((None,))
    if not items:
        raise _Unread
    return items[0] if len(items) == 1 else ("list", items)


def _same(a, b) -> bool:
    if isinstance(a, tuple) or isinstance(b, tuple):
        if not (isinstance(a, tuple) and isinstance(b, tuple)) or a[0] != b[0]:
            return False
        if a[0] in ("set", "union", "list"):
            return all(any(_same(x, y) for y in b[1]) for x in a[1]) and all(any(_same(x, y) for x in a[1]) for y in b[1])
        return len(a[1]) == len(b[1]) and all(map(_same, a[1], b[1]))
    if isinstance(a, Fraction) and isinstance(b, Fraction):
        return a == b
    if isinstance(a, float) and isinstance(b, float) and math.inf in (abs(a), abs(b)):
        return a == b
    x, y = complex(a), complex(b)
    return x == y or abs(x - y) <= NEAR * max(abs(x), abs(y)) < math.inf


def equal(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return False
    x, y = _plain(a), _plain(b)
    try:
        return all(_same(_read(x, k), _read(y, k)) for k in range(SAMPLES))
    except (_Unread, ArithmeticError, ValueError, RecursionError):
        return (p := re.sub(r"\s+", "", x)) != "" and p == re.sub(r"\s+", "", y)


@F.pandas_udf(BooleanType())
def latex_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two answers are equal; false for a null."""
    return pd.Series([equal(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def latex_reward(df: DataFrame, completion: str, gold: str, out: str = "reward") -> DataFrame:
    """``df`` with 1 where a completion's boxed answer (else what is in its answer tags) equals the gold one: what follows ``####``, else its box, else all of it."""
    c, g = F.col(completion), F.col(gold)
    said = F.coalesce(boxed(c), F.nullif(tag(c, "answer"), F.lit("")))
    want = F.when(g.contains("####"), F.substring_index(g, "####", -1)).otherwise(F.coalesce(boxed(g), g))
    # both are computed before Python sees them: a lambda among a UDF's arguments would keep it from running there
    d = computed(df, _said=to_text(said), _want=to_text(want))
    return d.withColumn(out, latex_equal("_said", "_want").cast("double")).drop("_said", "_want")
