"""Percentiles of very large numeric columns by merging centroid digests.

A digest of a group is a short list of centroids (mean, weight, least and greatest value).  Sorted
values are clustered under the size function ``k(q) = d/(2 pi) asin(2q - 1)``: clusters are small at
the tails and hold at most about ``pi/d`` of all values in the middle.  Digests of shards, days or
partitions are merged by clustering their centroids again.  Since every centroid knows the range of
its values, a digest bounds the rank of any value; a second counting pass makes it exact.

Everything is window and aggregate SQL: values are sorted and clustered inside salted buckets, so a
group that holds a third of all rows is spread over ``salts_for`` tasks, and only centroids meet.

Defined results: a sample counts once per ``sample_id`` (deliveries repeat it); null, NaN and
negative latencies don't count; names are compared without case and outer blanks; groups without a
value give no row, nor do samples without a series or a name; repeated values (ties) stay exact in rank bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELTA = 200
#: Samples of one group in one task, about, when a group holds a third of all.
SALT_ROWS = 200_000
FAN_IN = 16
#: Percentage points of rank by which a reported percentile may be off.
RANK_TOLERANCE = 2.0


def scenario(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"^\s+|\s+$", "")))


def salts_for(run_sample: DataFrame) -> int:
    """Tasks over which a group that holds a third of all samples is spread."""
    return 1 + run_sample.count() // (3 * SALT_ROWS)


def clean_samples(run_sample: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per counted sample: ``series_id, name, shard, day, salt, v``, laid out by (series, name, salt)."""
    salts = salts or salts_for(run_sample)
    v = F.col("latency_ms")
    rows = run_sample.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & F.col("sample_id").isNotNull() & F.col("series_id").isNotNull() & F.col("name").isNotNull()).select(
        "series_id",
        scenario(F.col("name")).alias("name"),
        F.pmod(F.xxhash64("sample_id"), F.lit(salts)).cast("int").alias("salt"),
        "sample_id",
        "shard",
        F.to_date("measured_at").alias("day"),
        v.alias("v"),
        "received_at",
    )
    # the first delivery counts; hash layout by the first three keys serves dedup and clustering alike
    laid = rows.repartition("series_id", "name", "salt")
    pick = F.min_by(F.struct("shard", "day", "v"), F.struct("received_at", "v"))
    one = laid.groupBy("series_id", "name", "salt", "sample_id").agg(pick.alias("s"))
    return one.select("series_id", "name", "salt", "s.shard", "s.day", "s.v")


def _scale(q: Column, delta: int) -> Column:
    return F.lit(delta / (2 * math.pi)) * F.asin(F.least(F.greatest(2 * q - 1, F.lit(-1.0)), F.lit(1.0)))


def _merge(cents: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """Cluster centroids again within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("mean", "lo", "hi", "weight")
    total = F.sum("weight").over(Window.partitionBy(*keys))
    before = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1))
    mid = (F.coalesce(before, F.lit(0)) + F.col("weight") / 2) / total
    c = cents.withColumn("c", F.floor(_scale(mid, delta)))
    return c.groupBy(*keys, "c").agg(
        (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
        F.sum("weight").alias("weight"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    ).drop("c")


def build_digests(samples: DataFrame, keys: list[str], delta: int = DELTA, spread: list[str] | None = None) -> DataFrame:
    """Digests ``keys + mean, weight, lo, hi`` of ``v``; ``spread`` columns split hot keys first."""
    parts = [*keys, *(spread if spread is not None else ["salt"])]
    point = samples.select(*dict.fromkeys(parts), F.col("v").alias("mean"), F.lit(1).cast("long").alias("weight"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    local = _merge(point, list(dict.fromkeys(parts)), delta)
    return _merge(local, keys, delta) if len(parts) > len(keys) else local


def merge_digests(digests: DataFrame, keys: list[str], fan_in: list[str] | None = None, delta: int = DELTA) -> DataFrame:
    """Digests of coarser ``keys`` from finer ones; ``fan_in`` columns give a level in between for hot keys."""
    if fan_in:
        buckets = digests.withColumn("b", F.pmod(F.xxhash64(*fan_in), F.lit(FAN_IN)))
        digests = _merge(buckets.select(*keys, "b", "mean", "weight", "lo", "hi"), [*keys, "b"], delta)
    return _merge(digests.select(*keys, "mean", "weight", "lo", "hi"), keys, delta)


def percentiles(digests: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Estimates ``keys + n, q, value, below_least, below_most``: the last two bound how many values lie below."""
    w = Window.partitionBy(*keys).orderBy("mean", "lo", "hi", "weight")
    total = F.sum("weight").over(Window.partitionBy(*keys))
    upto = F.sum("weight").over(w)
    c = digests.withColumn("n", total).withColumn("upto", upto)
    picked = [
        F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("n")), F.struct("upto", "mean", "lo", "hi")))
        for q in qs
    ]
    rows = c.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*[F.struct(F.lit(q).alias("q"), p.alias("c")) for q, p in zip(qs, picked)]).alias("p"), F.collect_list(F.struct("weight", "lo", "hi")).alias("cents"))
    e = rows.select(*keys, "n", F.explode("p").alias("p"), "cents").select(*keys, "n", "p.q", F.when(F.col("p.c.lo") == F.col("p.c.hi"), F.col("p.c.lo")).otherwise(F.col("p.c.mean")).alias("value"), "cents")
    return e.withColumns(_bounds(F.col("value"))).drop("cents")


def _bounds(value: Column) -> dict[str, Column]:
    """Least and most counts of values below ``value``, and of values at or below it, from centroid ranges."""
    def total(cond) -> Column:
        return F.aggregate(F.filter("cents", cond), F.lit(0).cast("long"), lambda a, c: a + c["weight"])

    return {
        "below_least": total(lambda c: c["hi"] < value),
        "below_most": total(lambda c: c["lo"] < value),
        "upto_least": total(lambda c: c["hi"] <= value),
        "upto_most": total(lambda c: c["lo"] <= value),
    }


def certified_percentiles(samples: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.5, 0.95), delta: int = DELTA, salts: int | None = None) -> DataFrame:
    """``keys + n, q, value, rank_error``: digest estimates with their true rank error from a counting pass.

    ``rank_error`` is in percentage points: the distance from ``100 q`` to the span between the
    percentage of values below the estimate and the percentage at or below it.  Samples whose key is
    null belong to no group.
    """
    samples = samples.dropna(subset=keys)
    est = percentiles(build_digests(samples, keys, delta), keys, qs).select(*keys, "n", "q", "value")
    wide = est.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("q", "value"))).alias("e"))
    # each estimate meets its group's values once per salt that the group has, so a hot group's count is spread too
    if salts:
        spread = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        spread = wide.join(samples.select(*keys, "salt").distinct(), keys)
    counts = [(F.sum((F.col("v") < F.get("e", F.lit(i))["value"]).cast("long")).alias(f"b{i}"), F.sum((F.col("v") <= F.get("e", F.lit(i))["value"]).cast("long")).alias(f"u{i}")) for i in range(len(qs))]
    flat = [c for pair in counts for c in pair]
    part = samples.join(spread, [*keys, "salt"]).groupBy(*keys, "salt").agg(F.first("n").alias("n"), F.first("e").alias("e"), *flat)
    whole = part.groupBy(*keys).agg(F.first("n").alias("n"), F.first("e").alias("e"), *[F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(len(qs)) for x in "bu"])
    rows = whole.select(*keys, "n", F.explode(F.array(*[F.struct(F.get("e", F.lit(i))["q"].alias("q"), F.get("e", F.lit(i))["value"].alias("value"), F.col(f"b{i}").alias("b"), F.col(f"u{i}").alias("u")) for i in range(len(qs))])).alias("x"))
    return rows.select(*keys, "n", "x.q", "x.value", offset(F.col("x.b"), F.col("x.u"), F.col("n"), 100 * F.col("x.q")).alias("rank_error"))


def offset(below: Column, upto: Column, n: Column, percent: Column) -> Column:
    """Percentage points from the rank span [below, upto] of ``n`` values to ``percent``."""
    return F.greatest(100.0 * below / n - percent, percent - 100.0 * upto / n, F.lit(0.0))


def wrong_reports(run_report: DataFrame, run_sample: DataFrame, tolerance: float = RANK_TOLERANCE, delta: int = DELTA) -> DataFrame:
    """``report_id`` of reports with a percentile off by more than ``tolerance`` points of rank.

    The digest of a report's samples bounds the rank of the reported value.  Where the bounds settle
    the verdict, it stands; the other reports go to the second pass, which counts their samples.
    Reports without a counted sample, and null percentiles, state nothing wrong.
    """
    keys = ["series_id", "name"]
    samples = clean_samples(run_sample)
    digests = build_digests(samples, keys, delta)
    stated = run_report.where("report_id is not null").select(
        "report_id", "series_id", scenario(F.col("name")).alias("name"),
        F.explode(F.array(F.struct(F.lit(50.0).alias("at"), F.col("median_latency_ms").alias("x")), F.struct(F.lit(95.0).alias("at"), F.col("p95_latency_ms").alias("x")))).alias("s"),
    ).select("report_id", "series_id", "name", "s.at", "s.x").where("x is not null and not isnan(x)").distinct()
    packed = digests.groupBy(*keys).agg(F.collect_list(F.struct("weight", "lo", "hi")).alias("cents"), F.sum("weight").alias("n"))
    ranked = stated.join(packed, keys).withColumns(_bounds(F.col("x")))
    # the offset is largest with the rank span at one end of its bounds, least when the bounds meet the mark
    sure_off = F.greatest(100.0 * F.col("below_least") / F.col("n") - F.col("at"), F.col("at") - 100.0 * F.col("upto_most") / F.col("n"))
    maybe_off = F.greatest(100.0 * F.col("below_most") / F.col("n") - F.col("at"), F.col("at") - 100.0 * F.col("upto_least") / F.col("n"))
    ranked = ranked.select("report_id", *keys, "at", "x", "n", (sure_off > tolerance).alias("wrong"), ((sure_off <= tolerance) & (maybe_off > tolerance)).alias("open"))
    settled = ranked.where("wrong").select("report_id")
    unsettled = ranked.where("open").select("report_id", *keys, "at", "x", "n")
    counted = (
        samples.select(*keys, "v")
        .join(unsettled, keys)
        .groupBy("report_id", "at", "x", "n")
        .agg(F.sum((F.col("v") < F.col("x")).cast("long")).alias("b"), F.sum((F.col("v") <= F.col("x")).cast("long")).alias("u"))
        .where(offset(F.col("b"), F.col("u"), F.col("n"), F.col("at")) > tolerance)
        .select("report_id")
    )
    return settled.unionByName(counted).distinct()
