"""A registry of record families: how raw rows of a kind become records, and records training items.

A family's functions take and return DataFrames, so a new kind of source is one registration, and a mixed table is built in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conversations import sharegpt
from . import records, turns

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Family:
    name: str
    normalize: Step
    render: Step


FAMILIES: dict[str, Family] = {}


def register(name: str, normalize: Step, render: Step) -> Family:
    """A later registration of a name wins."""
    FAMILIES[name] = Family(name, normalize, render)
    return FAMILIES[name]


def items(df: DataFrame, family: str) -> DataFrame:
    """Training items of rows of one family, with ``family``."""
    if family not in FAMILIES:
        raise KeyError(f"family {family!r} is not registered; known are {', '.join(sorted(FAMILIES))}")
    f = FAMILIES[family]
    return f.render(f.normalize(df)).withColumn("family", F.lit(family))


def mixed(parts: dict[str, DataFrame]) -> DataFrame:
    """Items of several families, rows by family; fields that a family lacks are null."""
    out = None
    for name, df in parts.items():
        made = items(df, name)
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    if out is None:
        raise ValueError("no family is given")
    return out


def _turn_items(df: DataFrame) -> DataFrame:
    good = df.where((F.col("quality_tier") == "A") & (F.col("prompt") != ""))
    return good.select("record_id", "conversation_id", "turn_ind", sharegpt(F.col("prompt"), F.col("target")).alias("conversations"))


# The system line and the format of a single question.
SYSTEM = "You are a financial reasoning assistant."
FORMAT = "Evidence:\n- ...\n\nProgram: ...\nAnswer: ..."

register("reasoning", lambda df: records.with_prompt(records.supervision(df), SYSTEM, FORMAT), records.sft_items)
register("turns", turns.turn_records, _turn_items)
