"""Sources. Every reader keeps reading distributed; order, where it matters, is an explicit column."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``.json`` holds a list or one object, ``.jsonl`` an object a line; a bad line fails the read."""
    r = spark.read.schema(schema) if schema else spark.read
    lines = path.rstrip("*/").endswith((".jsonl", ".ndjson"))
    return r.json(path, multiLine=not lines, mode="FAILFAST", ignoreLeadingWhiteSpace=True)


def read_wrapped(spark: SparkSession, path: str, row: str, keys: tuple[str, ...] = ("data", "records", "examples", "items")) -> DataFrame:
    """Rows (DDL ``row``) of the first of ``keys`` that a JSON object has (``data.train.records`` for nested
    ones), or of the object itself if it is a list. A file is one JSON value, so it is read by one task."""
    text = spark.read.text(path, wholetext=True)
    wrapped = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{row}>>") for k in keys]
    plain = F.from_json("value", f"array<struct<{row}>>")
    return text.select(F.inline(F.coalesce(*wrapped, plain)))


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL with ``reason``: null, ``skip_blank_line`` or ``drop_bad_json``; the parsed struct is ``row``."""
    lines = spark.read.text(path)
    blank = F.trim("value") == ""
    reason = F.when(blank, "skip_blank_line").when(F.try_parse_json("value").isNull(), "drop_bad_json")
    return lines.select("value", reason.alias("reason"), F.from_json("value", schema).alias("row"))


def read_numbered(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(file, line_no from 1, line) of text files; blank lines count but are left out.

    Files are read in splits by many tasks. Each split's lines are counted, sums over the splits before give its first number, and
    lines are numbered within their split; one row a split is broadcast, by a hash of its file. Both reads are planned
    at once, so they see the same splits; a line of a split without a count is an error."""
    at = ["_split", "_start"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("_split", F.xxhash64("file"))
    counts = lines.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_split").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(*at, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.coalesce(F.col("_before") + F.col("_at") - F.col("_first") + 1, F.raise_error(F.lit("files changed while they were read")).cast("long"))
    out = lines.join(F.broadcast(base), at, "left").select("file", number.alias("line_no"), F.col("value").alias("line"))
    return out if keep_blank else out.where(F.trim("line") != "")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, object) of files that hold JSON objects one after the other, with white space or literal
    ``\\n`` between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder().raw_decode
        gap = re.compile(r"(?:\s|\\n)*")
        for b in batches:
            rows = []
            for file, raw in zip(b["path"], b["content"], strict=True):
                text, at, n = bytes(raw).decode(), 0, 0
                while (at := gap.match(text, at).end()) < len(text):
                    value, at = decode(text, at)
                    rows.append((file, n, json.dumps(value, ensure_ascii=False)))
                    n += 1
            yield pd.DataFrame(rows, columns=["file", "at", "object"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, at long, object string")


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema)


def discover(spark: SparkSession, root: str, kind: str = "parquet", split: str | None = None) -> DataFrame:
    """All files of a kind below a folder, those with the split's name if given."""
    pattern = f"*{split}*.{kind}" if split else f"*.{kind}"
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.csv(root, header=True) if kind == "csv" else reader.format("json" if kind == "jsonl" else kind).load(root)


def require_one_kind(spark: SparkSession, root: str) -> str:
    """The one extension of the files below a folder; raises on several."""
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    found = sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(kind).distinct().collect())
    if len(found) != 1:
        raise ValueError(f"expected files of one kind, found {found}")
    return found[0]


def allowlist(lines: DataFrame, column: str = "value", keys: tuple[str, ...] = ("record_id", "id")) -> DataFrame:
    """Distinct ids of lines that are ids or JSON objects with one; an empty list raises."""
    line = F.trim(column)
    from_json = F.coalesce(*(F.get_json_object(line, f"$.{k}") for k in keys))
    ids = lines.select(F.when(line.startswith("{"), from_json).otherwise(line).alias("id")).where("id <> ''").distinct()
    if ids.isEmpty():
        raise ValueError("the allowlist has no id")
    return ids


def read_capped(spark: SparkSession, root: str, schema: T.StructType | str, most: int | None = None) -> DataFrame:
    """Rows of all JSONL files below a folder, ``most`` of them if given."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root)
    return rows.limit(most) if most is not None else rows


def validate_lines(lines: DataFrame, column: str = "value", roles: tuple[str, ...] = ("system", "human", "gpt")) -> DataFrame:
    """One row: lines, blank ones, those that are no JSON, those without a list of turns of known roles, and the
    valid ones. Nothing is kept of them."""
    blank, parsed = F.trim(column) == "", F.try_parse_json(column).isNotNull()
    turns = F.from_json(F.get_json_object(column, "$.conversations"), "array<struct<`from`:string,value:string>>")
    shaped = F.coalesce((F.size(turns) > 0) & F.forall(turns, lambda t: F.coalesce(t["from"].isin(*roles) & t["value"].isNotNull(), F.lit(False))), F.lit(False))
    kinds = {"blank": blank, "bad_json": ~blank & ~parsed, "bad_turns": ~blank & parsed & ~shaped, "valid": ~blank & parsed & shaped}
    return lines.agg(F.count("*").alias("lines"), *(F.count_if(c).alias(n) for n, c in kinds.items()))


def catalog_source(spark: SparkSession, name: str, split: str | None = None, **options: str) -> DataFrame:
    """Rows of a named data source that the session knows (Python data sources too); the hook for remote hubs."""
    reader = spark.read.format(name).options(**options)
    return (reader.option("split", split) if split else reader).load()


def decode_pages(files: DataFrame) -> DataFrame:
    """(path, text) of text and Markdown files from binaryFile rows: lines joined, a sentence end kept."""
    text = F.decode("content", "UTF-8")
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6}\s+|[*_`]", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return files.select("path", F.when(F.col("path").rlike(r"\.md$"), plain).otherwise(text).alias("text"))


def inventory(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Per folder: files, bytes and, if asked for, the hash of the sorted hashes of the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")
    sums = [F.count("*").alias("files"), F.sum("length").alias("bytes")]
    if content:
        sums.append(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ","), 256).alias("sha256"))
    return files.groupBy(folder).agg(*sums)


def rejects(df: DataFrame, reason: Column, mode: str = "quarantine") -> DataFrame:
    """``df`` with ``reject_reason``; in mode ``failfast`` the first rejected row fails the query."""
    if mode == "failfast":
        return df.withColumn("reject_reason", F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(None).cast("string")))
    return df.withColumn("reject_reason", reason)
