"""Pairs of answers that are equal, and pairs that aren't."""

import pytest

from loomspark.functions import latex

EQUAL = [
    (r"\frac{1}{2}", "0.5"), (r"\frac12", r"\dfrac{2}{4}"), ("1,234", "1234"), ("1{,}234", "1234"), (r"50\%", r"\frac{1}{2}"), (r"x = 5", "5"), (r"\sqrt{8}", r"2\sqrt2"), (r"\sqrt[3]{27}", "3"), (r"\sqrt[3]{-8}", "-2"),
    (r"(x+1)^2", "x^2+2x+1"), (r"\frac{x^2-1}{x-1}", "x + 1"), (r"\{1, 2, 3\}", r"\{3,2,1\}"), (r"\{1,1\}", r"\{1\}"), (r"(1, 2)", r"\left( 1,\; 2 \right)"), (r"[0, \infty)", r"\left[0,\infty\right)"), (r"(-\infty,1)\cup(2,3]", r"(2,3]\cup(-\infty,1)"),
    (r"2\pi", r"\pi \cdot 2"), (r"\sin^2 x + \cos^2 x", "1"), (r"e^{2}", "e e"), (r"90^\circ", "90"), (r"5 \text{ cm}", "5"), (r"\$12.50", "12.5"), (r"-\frac{3}{4}", r"\frac{-3}{4}"), ("2^{-1}", ".5"), ("5!", "120"), (r"|{-3}|", "3"), (r"x_1 + x_2", "x_2 + x_1"),
    (r"\text{yes}5", "5"), ("1, 2", "2,1"), (r"\frac{\frac{1}{2}}{3}", r"\frac{1}{6}"), (r"\emptyset", r"\{\}"), (r"\ln(e^3)", "3"), ("10^{400}", "10^{400}"), (r"\mathbf{v", r"\mathbf{v"), ("(1,234)", "(1, 234)"), ("3x", r"3 \times x"), ("2(3)", "6"), ("a b", "ba"),
]
UNEQUAL = [
    ("1", "2"), (r"\frac{1}{2}", "0.51"), ("x", "y"), (r"\{1,2\}", "(1,2)"), ("[1,2)", "[1,2]"), ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,2,3\}"), (r"x^2", "2x"), (r"\sqrt{2}", "1.41"), ("", ""), (None, "1"), (r"50\%", "50"), ("x_1", "x_2"), (r"\frac{1}{0}", "1"),
    ("(1,2)", "1"), (r"\infty", r"-\infty"), ("10^{400}", "10^{401}"), ("(" * 500, "1"), ("x+" * 3000 + "x", "3001x"), ("", None),
]


@pytest.mark.parametrize("pair", EQUAL)
def test_equal(pair):
    assert latex.equal(*pair) and latex.equal(*reversed(pair))


@pytest.mark.parametrize("pair", UNEQUAL)
def test_unequal(pair):
    assert not latex.equal(*pair) and not latex.equal(*reversed(pair))


def test_column(spark):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(EQUAL + UNEQUAL)], "k int, a string, b string").repartition(3)
    got = {r["k"]: r["e"] for r in df.select("k", latex.latex_equal("a", "b").alias("e")).collect()}
    assert got == {k: k < len(EQUAL) for k in range(len(EQUAL) + len(UNEQUAL))}


def test_reward(spark):
    rows = [(r"so \boxed{\frac{1}{2}}", "it is #### 0.5", 1.0), (r"<answer>0.50</answer>", r"\boxed{\frac12}", 1.0), ("0.5", "0.5", 0.0), (r"\boxed{x^2}", "2x", 0.0), (None, "1", 0.0), (r"\boxed{1}", None, 0.0)]
    df = spark.createDataFrame(rows, "c string, g string, want double")
    got = latex.latex_reward(df, "c", "g", "r").collect()
    assert len(got) == len(rows) and all(r["r"] == r["want"] for r in got)
