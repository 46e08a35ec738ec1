"""File sources: bounded text and image files under allowed roots, strict JSON, JSON lines."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024


class SourceError(ValueError):
    """A refused source; ``code`` is one of empty_roots, denied, read_failure, non_regular, too_large."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def check_path(path: str, allowed_roots: list[str], max_bytes: int = MAX_BYTES) -> str:
    """The real path of a regular file inside a root; a path outside never tells whether it exists."""
    if not allowed_roots:
        raise SourceError("empty_roots")
    roots = [os.path.realpath(r) for r in allowed_roots]
    real = os.path.realpath(path)
    if not any(real == r or real.startswith(r.rstrip(os.sep) + os.sep) for r in roots):
        raise SourceError("denied")
    if not os.path.exists(real):
        raise SourceError("read_failure")
    if not os.path.isfile(real):
        raise SourceError("non_regular")
    if os.path.getsize(real) > max_bytes:
        raise SourceError("too_large")
    return real


def read_binary(spark: SparkSession, path: str, allowed_roots: list[str], glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, length, content`` of the files under ``path``; larger ones are left out by their length alone."""
    real = os.path.realpath(path)
    roots = [os.path.realpath(r) for r in allowed_roots]
    if not roots:
        raise SourceError("empty_roots")
    if not any(real == r or real.startswith(r.rstrip(os.sep) + os.sep) for r in roots):
        raise SourceError("denied")
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(real)
    return df.where(F.col("length") <= max_bytes).select(F.regexp_replace("path", r"\Afile:", "").alias("path"), "length", "content")


def read_texts(spark: SparkSession, path: str, allowed_roots: list[str], glob: str = "*") -> DataFrame:
    """``path, sha256, text, valid``: strict UTF-8, byte order mark kept; text is null where invalid."""
    df = read_binary(spark, path, allowed_roots, glob)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.when(valid, F.col("content").cast("string")).alias("text"), valid.alias("valid"))


def strict_json(text: str, max_chars: int = 1024 * 1024, max_depth: int = 128):
    """Parse JSON; repeated keys at any depth, a byte order mark, NaN, size and depth beyond bounds are refused."""
    if len(text) > max_chars:
        raise ValueError("json_too_large")
    if text.startswith("﻿"):
        raise ValueError("json_bom")
    depth = deepest = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text):
        ch = m[0]
        if ch in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif ch in "]}":
            depth -= 1
    if deepest > max_depth:
        raise ValueError("json_too_deep")

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                raise ValueError("json_duplicate_key")
            out[k] = v
        return out

    def refuse(_):
        raise ValueError("json_constant")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines with a fixed schema and the file each row came from; blank lines are skipped."""
    return spark.read.schema(schema).option("pathGlobFilter", glob).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("lineSep", "\n").csv(path, header=True)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table of a small result."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])
