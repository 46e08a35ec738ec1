"""Validation of evaluation datasets: issues as rows, quotas against an expected table."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nfc(text: Column) -> Column:
    """Unicode NFC, Arrow-vectorised (SQL has no normaliser)."""

    def run(v: pa.Array) -> pa.Array:
        return pc.utf8_normalize(v, form="NFC")

    return F.arrow_udf(run, "string")(text)


def nfkc_lower(text: Column) -> Column:
    def run(v: pa.Array) -> pa.Array:
        return pc.utf8_normalize(v, form="NFKC")

    return F.lower(F.arrow_udf(run, "string")(text))


def normalised_hash(text: Column) -> Column:
    return F.sha2(F.encode(F.regexp_replace(nfc(text), r"\r\n?", "\n"), "utf-8"), 256)


def first_seen_conflicts(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the group's first value in order.

    The first value is an aggregate (no window over a group that may be very large) joined back.
    """
    first = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(value, order).alias("_first"))
    return rows.join(first, group).where(~F.col(value).eqNullSafe(F.col("_first"))).drop("_first")


def dataset_issues(records: DataFrame) -> DataFrame:
    """``idx, code`` of ``idx, id, family_id, split, category, rubric_kind, source_text, source_sha256``."""
    r = records.withColumn("_hash", normalised_hash(F.col("source_text")))
    rubric = r.where((F.col("category") == "exact") != (F.col("rubric_kind") == "exact")).select("idx", F.lit("rubric_category_mismatch").alias("code"))
    source = r.where(F.sha2(F.encode("source_text", "utf-8"), 256) != F.col("source_sha256")).select("idx", F.lit("source_hash_mismatch").alias("code"))
    twice = r.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("idx"))).where("_k > 1").select("idx", F.lit("duplicate_id").alias("code"))
    leak = first_seen_conflicts(r, "family_id", "split", "idx").select("idx", F.lit("family_split_leakage").alias("code"))
    conflict = first_seen_conflicts(r, "_hash", "family_id", "idx").select("idx", F.lit("source_family_conflict").alias("code"))
    return rubric.unionByName(source).unionByName(twice).unionByName(leak).unionByName(conflict)


def quota_issues(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + expected, actual`` of cells that differ; ``expected`` lists every cell."""
    j = expected.join(actual, keys, "left").na.fill(0, ["actual"])
    return j.where("expected <> actual")


def model_inputs(records: DataFrame, split: str) -> DataFrame:
    """The four fields a model may see of one split; never answers."""
    return records.where(F.col("split") == split).select("id", "language", F.col("source_text").alias("text"), "question")
