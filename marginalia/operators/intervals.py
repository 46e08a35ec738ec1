"""Interval operators over line spans: merging, overlap, containment, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_spans(spans: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Overlapping spans joined into islands; adjacent ones stay apart."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_i")


def _cells(lo: str, hi: str, width: int):
    return F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))


def contained(points: DataFrame, spans: DataFrame, key: str, point: str, start: str = "start_line", end: str = "end_line", width: int = 64) -> DataFrame:
    """Points with the spans that contain them: an equi-join on key and cell, then the bounds."""
    p = points.withColumn("_cell", F.floor(F.col(point) / width))
    s = spans.withColumn("_cell", _cells(start, end, width))
    return p.join(s, [key, "_cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_cell")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs of ``(l_start, l_end)`` and ``(r_start, r_end)`` of one key that share a position."""
    lc = left.withColumn("_cell", _cells("l_start", "l_end", width))
    rc = right.withColumn("_cell", _cells("r_start", "r_end", width))
    j = lc.join(rc, [key, "_cell"]).where((F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")))
    # a pair is told in the first cell that both have
    return j.where(F.col("_cell") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_cell")
