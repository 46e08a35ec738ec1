"""Seeded schedules and simulated budgeted runs, set-based."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_SLOTS = 100_000


def json_key(*parts: Column | str | int) -> Column:
    """Compact JSON array of strings and integers, for hashing (ASCII identifiers)."""
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p)
        else:
            out.append(F.lit(json.dumps(p, ensure_ascii=False, separators=(",", ":"))))
    return F.concat(F.lit("["), F.concat_ws(",", *out), F.lit("]"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def seeded_hash(algorithm: str, seed: str, kind: str, *parts: Column) -> Column:
    return F.sha2(json_key(algorithm, seed, kind, *parts), 256)


def schedule(tasks: DataFrame, arms: list[str], attempts: int, algorithm: str, seed: str) -> DataFrame:
    """``ordinal, family, task, language, attempt, arm`` in seeded order.

    ``tasks``: ``family, task, language``.  A schedule has at most ``MAX_SLOTS`` slots, which bounds
    the one global ordering.
    """
    n = tasks.limit(MAX_SLOTS // (len(arms) * attempts) + 1).count() * len(arms) * attempts
    if n > MAX_SLOTS:
        raise ValueError("slot_limit_exceeded")
    slots = tasks.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    slots = slots.withColumn("_f", seeded_hash(algorithm, seed, "family", quoted(F.col("family"))))
    slots = slots.withColumn("_a", seeded_hash(algorithm, seed, "arm", quoted(F.col("task")), F.col("attempt").cast("string"), quoted(F.col("arm"))))
    order = Window.orderBy("_f", "family", "language", "task", "attempt", "_a", "arm")
    return slots.withColumn("ordinal", F.row_number().over(order)).select("ordinal", "family", "task", "language", "attempt", "arm")


def simulate(outcomes: DataFrame, keys: list[str], request_timeout: int, run_timeout: int, spend_cap: int) -> DataFrame:
    """Per run (``keys``): where and why it stops, time and cost so far.

    ``outcomes``: ``keys, ordinal, status, duration, reserved, settled``.  Until the first stop both
    clocks are prefix sums, so every slot gets its own stop reason and the least ordinal decides.
    """
    w = Window.partitionBy(*keys).orderBy("ordinal")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    o = outcomes.withColumn("_t", F.coalesce(F.sum("duration").over(before), zero)).withColumn("_c", F.coalesce(F.sum("settled").over(before), zero))
    left = F.lit(run_timeout) - F.col("_t")
    deadline = F.least(F.lit(request_timeout), left)
    late = F.col("duration") >= deadline
    reason = (
        F.when(left <= 0, "run_timeout")
        .when(F.col("reserved") > F.lit(spend_cap) - F.col("_c"), "budget_exhausted")
        .when(late & (left <= request_timeout), "run_timeout")
        .when(late, "request_timeout")
        .when(F.col("settled").isNull(), "unknown_cost")
        .when(F.col("settled") > F.col("reserved"), "reservation_exceeded")
    )
    unstarted = (left <= 0) | (F.col("reserved") > F.lit(spend_cap) - F.col("_c"))
    o = o.withColumn("_why", reason).withColumn("_off", unstarted).withColumn("_late", late & ~unstarted).withColumn("_dl", deadline)
    stop = F.struct("ordinal", "_why", "_off", "_late", "_t", "_c", "_dl", "duration", "settled", "reserved")
    # a run that never stops ends with its last slot
    per = o.groupBy(*keys).agg(F.count("*").alias("planned"), F.min(F.when(F.col("_why").isNotNull(), stop)).alias("s"), F.sum("duration").cast("long").alias("_all_t"), F.sum("settled").cast("long").alias("_all_c"))
    s, stopped = "s.", F.col("s").isNotNull()
    started = F.when(stopped, F.col(s + "ordinal") - F.when(F.col(s + "_off"), 1).otherwise(0)).otherwise(F.col("planned"))
    elapsed = F.when(~stopped, F.col("_all_t")).when(F.col(s + "_off"), F.col(s + "_t")).when(F.col(s + "_late"), F.col(s + "_t") + F.col(s + "_dl")).otherwise(F.col(s + "_t") + F.col(s + "duration"))
    known = F.when(~stopped, F.col("_all_c")).when(F.col(s + "_off") | F.col(s + "_late"), F.col(s + "_c")).otherwise(F.col(s + "_c") + F.coalesce(F.col(s + "settled"), zero))
    unknown = stopped & ~F.col(s + "_off") & (F.col(s + "_late") | F.col(s + "settled").isNull())
    return per.select(
        *keys, "planned", started.cast("long").alias("started"), F.when(stopped, F.col(s + "_why")).otherwise("schedule_exhausted").alias("stop_reason"),
        elapsed.cast("long").alias("elapsed_ms"), known.cast("long").alias("known_cost"), F.when(~unknown, known).cast("long").alias("settled_cost"),
        F.when(unknown, F.col(s + "reserved")).otherwise(zero).cast("long").alias("held"),
    )
