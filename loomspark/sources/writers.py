"""Sinks. One file only where a caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined with ``;`` and structs or maps as JSON, so that a row fits into CSV."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "array":
            c = F.array_join(c.cast("array<string>"), ";")
        elif kind in ("struct", "map", "variant"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row DataFrame as one JSON object."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)


def write_fan_out(df: DataFrame, path: str, by: str = "bucket") -> None:
    df.write.partitionBy(by).json(path)


def merged(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
