"""What SQL text may call: the evaluators that run in Python, and the reader of JSON objects that stand one after the other."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import program as P
from .latex import latex_equal
from .text import flat_texts

#: Types that a schema of ``json_objects`` may name.
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
GAP = re.compile(r"(?:\s|\\n)*")
_READ = {"string": lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), "int": int, "bigint": int, "double": float, "boolean": bool}


def _fields(schema: str) -> list[tuple[str, str]]:
    pairs = [tuple(p.split()) for p in schema.split(",")]
    if not all(len(p) == 2 and p[1].lower() in TYPES for p in pairs):
        raise ValueError(f"a schema is 'name type, name type'; types are {', '.join(TYPES)}")
    return [(n, t.lower()) for n, t in pairs]


class JsonObjects:
    """Rows (at, the fields of ``schema``) of the JSON objects in a text, with white space or literal ``\\n`` between them. The rest after something that
    isn't JSON is one row with null fields. A field that is missing or of another type is null; so is every field of what is no object."""

    @staticmethod
    def analyze(text: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(schema.value, str):
            raise ValueError("the schema must be a constant text")
        out = T.StructType().add("at", T.LongType())
        for n, t in _fields(schema.value):
            out = out.add(n, TYPES[t])
        return AnalyzeResult(schema=out)

    def eval(self, text: str | None, schema: str):
        fields, decode, at, n = _fields(schema), json.JSONDecoder().raw_decode, 0, 0
        text = text or ""
        while (at := GAP.match(text, at).end()) < len(text):
            try:
                value, at = decode(text, at)
            except json.JSONDecodeError:
                value, at = None, len(text)
            yield (n, *(self._read(value, name, kind) for name, kind in fields))
            n += 1

    @staticmethod
    def _read(value: object, name: str, kind: str) -> object:
        v = value.get(name) if isinstance(value, dict) else None
        try:
            return None if v is None else _READ[kind](v)
        except (TypeError, ValueError, OverflowError):
            return None


def register(spark: SparkSession) -> list[str]:
    """The names that SQL text may call from now on in this session."""
    made = {"loom_execute": P.execute, "loom_strict_reasons": P.strict_reasons, "loom_latex_equal": latex_equal, "loom_flat_texts": flat_texts}
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("loom_json_objects", udtf(JsonObjects))
    return [*made, "loom_json_objects"]
