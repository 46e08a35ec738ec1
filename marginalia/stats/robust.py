"""Quantiles, noise measures, gates and seeded bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.prng import mulberry32, mulberry32_block
from marginalia.runtime import cut

#: Differences that a bootstrap of means takes, one per family.
MAX_DIFFS = 10_000
# How much slower a change may be, and how far two equal builds may be apart.
GATE, NOISE = 1.03, 0.03


def sample_cv(value: Column) -> Column:
    return F.stddev_samp(value) / F.avg(value)


def type7(value: str, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.expr(f"percentile({value}, {q})")


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` (from 0) within ``keys`` by ``order`` and the group's size ``_n``.

    Rows are laid out by range over keys and order together, so a group that holds a third of all
    rows lies in many tasks; a task's own ranks are offset by what lies in the tasks before it.  The
    layout is written once, so that a repeated task sees the same ranges.  ``order`` should end in a
    column that tells rows apart: equal rows can't be parted.
    """
    laid = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = cut(laid.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    own = [f"_key{i}" for i in range(len(keys))]
    runs = laid.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], part.alias("_part")).agg(F.min("_m").alias("_first"), F.count("*").alias("_k"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(*own)))
    on = part == F.col("_part")
    for k, o in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return laid.join(runs, on).select(*rows.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("_rank"), "_n")


def order_statistics(ranked_rows: DataFrame, keys: list[str], value: str, disc: dict[str, float] = {}, cont: dict[str, float] = {}) -> DataFrame:  # noqa: B006
    """``keys + n`` and a column per name: nearest ranks (``disc``) and type-7 quantiles (``cont``) of ranked rows."""
    at = lambda r: F.max(F.when(F.col("_rank") == r, F.col(value)))
    out = [F.max("_n").alias("n")]
    for name, p in disc.items():
        out.append(at(F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1)) - 1).alias(name))
    for name, q in cont.items():
        h = (F.col("_n") - 1) * F.lit(q)
        low, high, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        out.append((low + (high - low) * part).alias(name))
    return ranked_rows.groupBy(*keys).agg(*out)


def bootstrap_means(diffs: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``i, mean`` of ``rounds`` resamples of ``diffs`` (``j`` from 0, ``d``), reproducible from the seed.

    Draw (i, j) is number i*n + j + 1 of a counter-based generator, so a round is one row that needs no
    other.  The differences (at most ``MAX_DIFFS``) are a constant of the query; more raise.
    """
    spark = diffs.sparkSession
    d = [r["d"] for r in diffs.select("j", "d").orderBy("j").limit(MAX_DIFFS + 1).collect()]
    if len(d) > MAX_DIFFS:
        raise ValueError("too_many_differences")
    n = len(d)
    if n == 0:
        return spark.createDataFrame([], "i long, mean double")
    values = F.array(*[F.lit(float(x)) for x in d])
    u = lambda k: mulberry32(F.lit(seed).cast("long"), F.col("id") * n + k + 1)
    pick = lambda k: F.get(values, F.floor(u(k) / F.lit(4294967296.0) * n).cast("int"))
    # added in draw order, so equal seeds give equal bits
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + pick(k))
    return spark.range(rounds).select(F.col("id").alias("i"), (total / n).alias("mean"))


def interval(means: DataFrame, rounds: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Order statistics floor(low B) and ceil(high B) - 1 (from 0) of the resampled means; nulls without any."""
    sorted_means = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))  # rounds values, a fixed number
    return sorted_means.select(F.get("m", F.lit(int(low * rounds))).alias("lo"), F.get("m", F.lit(-int(-high * rounds // 1) - 1)).alias("hi"))


def drift(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of the first half of each group's rows (the larger one) and of the rest, and late over early."""
    r = ranked(samples.select(*keys, *order, value), keys, order)
    first = F.col("_rank") < F.ceil(F.col("_n") / 2)
    early, late = F.avg(F.when(first, F.col(value))), F.avg(F.when(~first, F.col(value)))
    return r.groupBy(*keys).agg(early.alias("early"), late.alias("late"), F.try_divide(late, early).alias("ratio"))


def median(values: Column) -> Column:
    """Middle value of an array, or the mean of the two in the middle."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def block_bootstrap(recipes: DataFrame, key: str, blocks: str, rounds: int, seed: int) -> DataFrame:
    """``key, point, lo, hi``: median over all ratios, and the 95 % interval of medians of resampled whole blocks.

    ``blocks`` is an array of equally long arrays of ratios.  All recipes share the draws; a recipe is one row.
    """
    kind = recipes.schema[key].dataType.simpleString()

    def one(x: np.ndarray) -> tuple[float, float, float]:
        n = len(x)
        at = np.floor(mulberry32_block(seed, rounds * n) / 4294967296.0 * n).astype(int).reshape(rounds, n)
        medians = np.median(x[at].reshape(rounds, -1), axis=1)
        return (float(np.median(x)), *map(float, np.quantile(medians, [0.025, 0.975])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *one(np.array([list(v) for v in x]))) for k, x in zip(pdf[key], pdf[blocks]) if x is not None and len(x)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "point", "lo", "hi"])

    return recipes.select(key, blocks).mapInPandas(run, f"`{key}` {kind}, point double, lo double, hi double")


def ratio_bootstrap(a: list[float], b: list[float], seed: int, rounds: int = 10_000, gate: float = GATE) -> dict[str, float | list[float]]:
    """Median of ratios and ratio of medians of two paired series of one recipe, with 95 % intervals and shares over the gate.

    One recipe's series is a handful of rounds; the draws come one after another from one generator.
    """
    x, y = np.array(a), np.array(b)
    n = len(x)
    at = (np.array(lcg(seed, rounds * n)) * n).astype(int).reshape(rounds, n)
    paired, whole = np.median(y[at] / x[at], axis=1), np.median(y[at], axis=1) / np.median(x[at], axis=1)
    ci = lambda v: [round(float(np.sort(v)[int(0.025 * rounds)]), 4), round(float(np.sort(v)[int(0.975 * rounds) - 1]), 4)]
    over = lambda v: round(float((v > gate).mean()), 4)
    return {
        "median_ratio": round(float(np.median(y) / np.median(x)), 4), "paired_ratio": round(float(np.median(y / x)), 4),
        "paired_ci": ci(paired), "ratio_ci": ci(whole), "paired_over": over(paired), "ratio_over": over(whole),
    }


def gate_verdict(aa_ratio: Column, point: Column, upper: Column, valid: Column, gate: float = GATE, noise: float = NOISE) -> Column:
    """INVALID before FAIL before BORDERLINE before PASS."""
    return (
        F.when(~valid | (aa_ratio < 1 - noise) | (aa_ratio > 1 + noise), "INVALID")
        .when(point > gate, "FAIL")
        .when(upper > gate, "BORDERLINE")
        .otherwise("PASS")
    )


def paired_verdict(lo: Column, hi: Column, fewer_tokens: Column, margin: float = 0.05) -> Column:
    return F.when(lo > 0, "superior").when(hi < 0, "inferior").when((lo > -margin) & fewer_tokens, "non_inferior").otherwise("undecided")


def lcg(seed: int, count: int, a: int = 1664525, c: int = 1013904223) -> list[float]:
    """``count`` numbers in [0, 1) of a 32-bit linear congruential generator, for small seeded orders on the driver."""
    out, x = [], seed & 0xFFFFFFFF
    for _ in range(count):
        x = (a * x + c) & 0xFFFFFFFF
        out.append(x / 4294967296)
    return out


def seeded_shuffle(items: list, seed: int) -> list:
    """Fisher-Yates from the back with the generator above."""
    out = list(items)
    for i, u in zip(range(len(out) - 1, 0, -1), lcg(seed, max(0, len(out) - 1))):
        j = int(u * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
