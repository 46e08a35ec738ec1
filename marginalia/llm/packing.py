"""Filling fixed-capacity windows with texts, with little room left over.

The plan is made on the histogram of sizes, which has at most ``capacity`` bins whatever the data's
size: combinations of lengths that fill a window exactly are enumerated from what the histogram
holds, how often to repeat each is solved by non-negative least squares against the histogram,
rounded within what is there, and the same is done with the rest until little of it can be filled
so; what remains is packed greedily, largest length first.  A round enumerates at most
``MAX_PATTERNS`` combinations from the histogram scaled down to that many windows, so every length
is in them about as often as in the data, however much data there is.  Texts are then matched to the
plan's places by their rank within their length, in parallel and without a sort across lengths.

Defined results: texts without tokens take no place; a text larger than the window is divided into
full windows and one rest, and only such texts are; null ids are left out; equal texts are packed
each; ties are ordered by id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.runtime import cut

#: Items of one length that are ranked in one task, about.
BUCKET_ITEMS = 100_000
MAX_PATTERNS = 2_000
#: Rounds of enumeration and least squares, and the share of the windows that a round must place to be followed by another.
ROUNDS, LEAST_PLACED = 16, 0.01
#: Share of each length that is kept for the greedy rest, which else lacks short pieces.
SPARE = 0.04
SEED = 20260302
Pattern = tuple[tuple[int, int], ...]


def _closing(pool: np.ndarray, room: int, rnd: np.random.Generator) -> list[int] | None:
    """Up to three lengths of the pool that fill ``room`` exactly; None without."""
    if room == 0:
        return []
    if pool[room]:
        return [room]

    def pair(r: int) -> list[int] | None:
        half = r // 2
        both = (pool[1 : half + 1] > 0) & (pool[r - 1 : r - half - 1 : -1] > 0)
        if r % 2 == 0 and half and pool[half] == 1:
            both[half - 1] = False
        at = np.flatnonzero(both)
        if not len(at):
            return None
        x = int(at[-1]) + 1  # short lengths are kept for later
        return [x, r - x]

    if room >= 2 and (two := pair(room)):
        return two
    have = np.flatnonzero(pool[:room])
    for a in have[rnd.permutation(len(have))[:8]]:
        a = int(a)
        pool[a] -= 1
        two = pair(room - a) if room - a >= 2 else None
        pool[a] += 1
        if two:
            return [a, *two]
    return None


def enumerate_combinations(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = MAX_PATTERNS, seed: int = SEED) -> list[Pattern]:
    """Patterns ((length, times), ...) that fill ``capacity`` exactly, for about ``most`` windows of the histogram.

    The histogram is scaled down to that many windows.  A part of it is kept as a pool for closing; the
    rest is laid in a row in seeded order and cut into windows, whose last bits the pool fills.
    """
    rnd = np.random.default_rng(seed)
    scale = max(1.0, float(lengths @ counts) / capacity / most)
    small = np.minimum(counts, np.floor(counts / scale + rnd.random(len(counts)))).astype(np.int64) if scale > 1 else counts.copy()
    kept = rnd.binomial(small, 0.3)
    pool = np.zeros(capacity + 1, dtype=np.int64)
    pool[lengths] = kept
    deck = np.repeat(lengths, small - kept)
    rnd.shuffle(deck)
    # lengths of which a window takes one come first, the longest with the fewest to go with it
    large, deck = np.sort(deck[2 * deck > capacity])[::-1], deck[2 * deck <= capacity]
    upto = np.concatenate([[0], np.cumsum(deck)])
    patterns: dict[Pattern, None] = {}
    i = at = 0
    while i < len(deck) or at < len(large):
        first = large[at : at + 1]
        at += 1
        room = capacity - int(first.sum())
        j = int(np.searchsorted(upto, upto[i] + room, side="right")) - 1
        fill, end = None, j
        while (end > i or len(first) and end == i) and end >= j - 2 and (fill := _closing(pool, room - int(upto[end] - upto[i]), rnd)) is None:
            end -= 1
        if fill is None:
            i = j if not len(first) else i
            continue
        for x in fill:
            pool[x] -= 1
        length, times = np.unique(np.concatenate([first, deck[i:end], np.array(fill, dtype=np.int64)]), return_counts=True)
        patterns.setdefault(tuple(zip(length[::-1].tolist(), times[::-1].tolist())))
        i = end
    return list(patterns)


def solve_repeats(patterns: list[tuple[tuple[int, int], ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of repeat counts: accelerated projected gradient on the sparse pattern matrix."""
    if not patterns:
        return np.zeros(0)
    at = {int(x): i for i, x in enumerate(lengths)}
    row = np.array([at[x] for p in patterns for x, _ in p])
    col = np.array([i for i, p in enumerate(patterns) for _ in p])
    val = np.array([t for p in patterns for _, t in p], dtype=float)
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))  # large bins don't drown small ones
    val, goal = val * scale[row], counts * scale
    m, n = len(lengths), len(patterns)
    forward = lambda x: np.bincount(row, val * x[col], m)
    back = lambda y: np.bincount(col, val * y[row], n)
    v = np.ones(n)
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / max(float(v @ back(forward(v))), 1e-9)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(forward(y) - goal), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        if np.abs(new - x).max() < 1e-4:
            x = new
            break
        x, t = new, t2
    return x


@dataclass(frozen=True)
class Plan:
    """Windows of one capacity: patterns, how often each repeats, and where each length's ranks go."""

    capacity: int
    patterns: list[Pattern]
    repeats: list[int]
    solved: int = 0  # windows that least squares placed; they come first

    @property
    def windows(self) -> int:
        return sum(self.repeats)

    def places(self) -> dict[str, np.ndarray]:
        """Per length sorted runs of ranks: ``length, start, times, first`` (first window of the pattern)."""
        used: dict[int, int] = {}
        rows = []
        first = 0
        for p, r in zip(self.patterns, self.repeats):
            for length, times in p:
                start = used.get(length, 0)
                rows.append((length, start, times, first))
                used[length] = start + times * r
            first += r
        rows.sort()
        a = np.array(rows, dtype=np.int64).reshape(-1, 4)
        return dict(zip(("length", "start", "times", "first"), a.T))


def plan_windows(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan that places every item of the histogram (lengths 1..capacity) once."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0 and 0 < k <= capacity), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    left = dict(zip(lengths.tolist(), counts.tolist()))
    patterns, repeats = [], []
    spare = np.random.default_rng(SEED).binomial(counts, SPARE)
    left = {k: n - int(x) for (k, n), x in zip(left.items(), spare)}
    for turn in range(ROUNDS):
        lengths = np.array([k for k, n in left.items() if n], dtype=np.int64)
        counts = np.array([left[int(k)] for k in lengths], dtype=np.int64)
        if not len(lengths):
            break
        combos = enumerate_combinations(lengths, counts, capacity, seed=SEED + turn)
        x = solve_repeats(combos, lengths, counts.astype(float))
        placed = 0
        for i in np.argsort(-x, kind="stable"):
            want = min([int(np.floor(x[i] + 0.5)), *(left[k] // t for k, t in combos[i])])
            if want > 0:
                patterns.append(combos[i])
                repeats.append(want)
                placed += want
                for k, t in combos[i]:
                    left[k] -= t * want
        if placed < max(1.0, LEAST_PLACED * float(lengths @ counts) / capacity):
            break
    solved = sum(repeats)
    left = {k: n + int(x) for (k, n), x in zip(left.items(), spare)}
    free = sorted(k for k, n in left.items() if n)
    while free:
        room, taken = capacity, {}
        hi = len(free)
        while hi:
            hi = bisect_right(free, room, 0, hi)
            if not hi:
                break
            k = free[hi - 1]
            times = min(room // k, left[k])
            taken[k] = times
            room -= times * k
            hi -= 1
        again = min(left[k] // t for k, t in taken.items())
        patterns.append(tuple(sorted(taken.items(), reverse=True)))
        repeats.append(again)
        for k, t in taken.items():
            left[k] -= t * again
        free = [k for k in free if left[k]] if any(not left[k] for k in taken) else free
    return Plan(capacity, patterns, repeats, solved)


def divide(sized: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_name, capacity, doc_id, piece, start, size``: each text once per window kind, divided only if larger."""
    small = [(r["window_name"], int(r["capacity_tokens"])) for r in windows.where("capacity_tokens > 0 and window_name is not null").distinct().collect()]
    kinds = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(small)])
    each = sized.where("doc_id is not null and n_tokens > 0").select("doc_id", "n_tokens", F.explode(kinds).alias("w")).select("w.*", "doc_id", "n_tokens")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("long"))
    return each.select("window_name", "capacity", "doc_id", "n_tokens", F.explode(pieces).alias("piece")).select(
        "window_name", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"),
        F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size"),
    )


def pack(sized: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_name, capacity, window_id, doc_id, piece, start, size, solved``: every piece in one window.

    ``solved`` windows are those that least squares placed, the others were packed greedily.
    ``sized`` has ``doc_id, n_tokens``; ``windows`` has ``window_name, capacity_tokens`` (a fixed
    few).  The histograms on the driver have at most ``capacity`` rows per window kind.  Ranks within
    a length are counted in hashed buckets, so a length that a third of all texts have is split.
    """
    spark = sized.sparkSession
    schema = "window_name string, capacity long, window_id long, doc_id long, piece long, start long, size long, solved boolean"
    buckets = 1 + sized.count() // BUCKET_ITEMS
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    items = divide(sized, windows).withColumn("bucket", bucket)
    counts = cut(items.groupBy("window_name", "capacity", "size", "bucket").agg(F.count("*").alias("n")))
    bins = counts.groupBy("window_name", "capacity", "size").agg(F.sum("n").alias("n")).collect()  # <= capacity rows per window kind
    if not bins:
        return spark.createDataFrame([], schema)
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    for r in bins:
        histograms.setdefault((r["window_name"], int(r["capacity"])), {})[int(r["size"])] = int(r["n"])
    plans = {name: plan_windows(h, capacity) for (name, capacity), h in histograms.items()}
    shared = spark.sparkContext.broadcast({name: (p.places(), p.solved) for name, p in plans.items()})
    # ranks within a length: those of the buckets before, plus the place in the own bucket
    sizes = ["window_name", "size", "bucket"]
    before = Window.partitionBy("window_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*sizes, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy(*sizes).orderBy("doc_id", "piece")
    ranked = items.withColumn("own", F.row_number().over(order) - 1).join(offsets, sizes).withColumn("rank", F.col("own") + F.col("offset"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, g in pdf.groupby("window_name", sort=False):
                places, solved = shared.value[name]
                size, rank = g["size"].to_numpy(), g["rank"].to_numpy()
                base = int(max(places["start"].max(), rank.max())) + 1
                k = np.searchsorted(places["length"] * base + places["start"], size * base + rank, side="right") - 1
                window = places["first"][k] + (rank - places["start"][k]) // places["times"][k]
                out.append(g.assign(window_id=window, solved=window < solved)[["window_name", "capacity", "window_id", "doc_id", "piece", "start", "size", "solved"]])
            if out:
                yield pd.concat(out)

    return ranked.select("window_name", "capacity", "size", "doc_id", "piece", "start", "rank").mapInPandas(place, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """``window_name, capacity, windows, pieces, tokens, room, least_windows, fill, solved_share``: the last is of the tokens."""
    per = packed.groupBy("window_name", "capacity", "window_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.sum(F.when(F.col("solved"), F.col("size")).otherwise(0)).alias("placed"))
    whole = per.groupBy("window_name", "capacity").agg(F.count("*").alias("windows"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("placed").alias("placed"))
    return whole.select(
        "window_name", "capacity", "windows", "pieces", "tokens",
        (F.col("windows") * F.col("capacity") - F.col("tokens")).alias("room"),
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_windows"),
        F.round(F.col("tokens") / (F.col("windows") * F.col("capacity")), 6).alias("fill"),
        F.round(F.col("placed") / F.col("tokens"), 6).alias("solved_share"),
    )
