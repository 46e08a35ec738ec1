"""Mixing sources to target weights.

A mix's total is divided into blocks of equally many tokens.  Sainte-Lague apportionment (the next
block goes to the source with the highest quotient weight / (2 blocks + 1)) gives each source an
integer quota of blocks, and within a source each shard of its documents, so shards can be filled
independently.  A quota is filled in seeded order: all documents of a shard as often as whole rounds
fit, then whole documents up to the quota's end, never more often than ``max_repeats``.

Defined results: source names are compared without case, blanks and separators' spelling; sources
without tokens get nothing and are reported with share 0; the total, when none is given, is the
largest at which every source that has documents can reach its share; null texts have no tokens.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.runtime import cut

BLOCK_TOKENS = 256
DOCS_PER_SHARD = 20_000
SEED = 20260301
#: Divisors tried in a pass, and passes: 64^7 is 2^42.
WAYS, PASSES = 64, 7


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")


def sainte_lague(weights: dict, blocks: int, caps: dict | None = None) -> dict:
    """Blocks per key by highest quotients; ``caps`` bound what a key can take.  Ties go to the least key.

    All quotients of at least some divisor are dealt at once: the divisor is found by bisection, so that
    what is left to deal one by one is at most a block per key or so.
    """
    caps = caps or {}
    live = {k: Fraction(w).limit_denominator(10**12) for k, w in weights.items() if w > 0}
    seats = dict.fromkeys(weights, 0)
    room = {k: max(0, caps.get(k, blocks)) for k in live}
    left = min(blocks, sum(room.values()))
    if left <= 0:
        return seats

    def dealt(divisor: Fraction) -> dict:
        return {k: min(room[k], math.floor((w / divisor + 1) / 2)) for k, w in live.items()}

    low, high = 0.0, float(max(live.values())) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(dealt(Fraction(mid)).values()) > left else (low, mid)
    seats |= dealt(Fraction(high))
    left -= sum(seats.values())
    heap = [(-w / (2 * seats[k] + 1), k) for k, w in live.items() if seats[k] < room[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        seats[k] += 1
        left -= 1
        if seats[k] < room[k]:
            heapq.heappush(heap, (-live[k] / (2 * seats[k] + 1), k))
    return seats


def shard_quotas(shards: DataFrame, quotas: DataFrame, block: int) -> DataFrame:
    """``mix_name, source, shard, quota, most, held``: each source's blocks dealt to its shards by highest quotients.

    ``shards``: ``source, shard, held`` (tokens); ``quotas``: ``mix_name, source, blocks, most`` (a row per target).  The divisor of
    each row is narrowed ``WAYS`` ways a pass by sums over all shards, so no shard is collected; the
    quotients within the last interval are dealt by rank.
    """
    cap = F.ceil(F.col("held") * F.col("most") / F.lit(block))
    each = cut(shards.where("held > 0").join(F.broadcast(quotas), "source").withColumn("cap", cap))  # a row per target
    dealt = lambda d: F.least(F.col("cap"), F.floor((F.col("held") / d + 1) / 2))
    keys = ["mix_name", "source"]
    # at the least divisor every shard has its cap, at the largest none has a block
    first = each.groupBy(*keys).agg((F.max("held") * 2.0).alias("high"), F.least(F.first("blocks"), F.sum("cap")).alias("blocks")).collect()  # a row per target
    spans = {(r["mix_name"], r["source"]): (r["high"] * 2.0**-45, r["high"], r["blocks"]) for r in first}
    schema = "mix_name string, source string, low double, high double"
    open_ = set(spans)
    for _ in range(PASSES):
        if not open_:
            break
        at = lambda i: F.col("low") * F.pow(F.col("high") / F.col("low"), F.lit(i / WAYS))
        rows = [(*k, *spans[k][:2]) for k in sorted(open_)]
        j = each.join(F.broadcast(shards.sparkSession.createDataFrame(rows, schema)), keys)  # a row per target
        tried = [F.struct(F.first(at(i)).alias("d"), F.sum(dealt(at(i))).alias("n")) for i in range(1, WAYS)]
        for r in j.groupBy(*keys).agg(F.array(*tried).alias("cuts")).collect():
            k = (r["mix_name"], r["source"])
            lo, hi, blocks = spans[k]
            above, below = [c["d"] for c in r["cuts"] if c["n"] <= blocks], [c["d"] for c in r["cuts"] if c["n"] > blocks]
            spans[k] = (max(below, default=lo), min(above, default=hi), blocks)
            if any(c["n"] == blocks for c in r["cuts"]):
                open_.discard(k)
    rows = [(*k, lo, hi) for k, (lo, hi, _) in spans.items()]
    j = each.join(F.broadcast(shards.sparkSession.createDataFrame(rows, schema)), keys)  # a row per target
    j = j.withColumn("n", dealt(F.col("high"))).withColumn("more", dealt(F.col("low")))
    near = j.where("more > n").join(F.broadcast(j.sparkSession.createDataFrame([*sorted(open_)] or [("", "")], "mix_name string, source string")), keys).withColumn("k", F.explode(F.sequence(F.col("n"), F.col("more") - 1)))
    total = j.groupBy(*keys).agg((F.least(F.first("blocks"), F.sum("cap")) - F.sum("n")).alias("left"))
    order = Window.partitionBy(*keys).orderBy((F.col("held") / (2 * F.col("k") + 1)).desc(), "shard")
    extra = near.withColumn("r", F.row_number().over(order)).join(F.broadcast(total), keys).where("r <= left").groupBy(*keys, "shard").agg(F.count("*").alias("extra"))  # a row per target
    q = j.join(extra, [*keys, "shard"], "left").withColumn("q", F.col("n") + F.coalesce("extra", F.lit(0)))
    return q.where("q > 0").select(*keys, "shard", F.least(F.col("q") * block, F.col("held") * F.col("most")).cast("long").alias("quota"), "most", "held")


def _targets(mix_target: DataFrame) -> list[dict]:
    rows = mix_target.where("mix_name is not null and source is not null and target_share > 0").select(
        "mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("most")
    )
    return [r.asDict() for r in rows.groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).orderBy("mix_name", "source").collect()]  # a fixed few


def _quotas(targets: list[dict], tokens: dict[str, int], total_tokens: int | None, block: int) -> list[tuple[str, str, int, int]]:
    """(mix, source, blocks, max repeats)."""
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        own = {t["source"]: t for t in targets if t["mix_name"] == mix}
        alive = {s: own[s]["share"] for s in own if tokens.get(s, 0) > 0}
        if not alive:
            continue
        whole = sum(alive.values())
        reach = min(tokens[s] * own[s]["most"] * whole / alive[s] for s in alive)
        blocks = max(1, int((total_tokens if total_tokens is not None else reach) // block))
        caps = {s: -(-tokens[s] * own[s]["most"] // block) for s in alive}  # the last block may be a part
        out += [(mix, s, n, own[s]["most"]) for s, n in sainte_lague(alive, blocks, caps).items() if n]
    return out


def mix(sized: DataFrame, mix_target: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, seed: int = SEED, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, copies`` from ``sized`` (``doc_id, source, n_tokens``).

    A source has one shard per ``docs_per_shard`` documents, so a shard's ordering is a bounded task
    however large a source is.  The driver holds a row per target only; shards' quotas are found in SQL.
    """
    spark = sized.sparkSession
    schema = "mix_name string, source string, doc_id long, n_tokens long, copies long"
    targets = _targets(mix_target)
    names = sorted({t["source"] for t in targets})
    docs = sized.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").where("doc_id is not null and n_tokens > 0").where(F.col("source").isin(names))
    docs = cut(docs)
    sizes = {r["source"]: (r["n"], int(r["t"])) for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # a row per target
    if not sizes:
        return spark.createDataFrame([], schema)
    n_shards = F.create_map(*[x for s, (n, _) in sizes.items() for x in (F.lit(s), F.lit(-(-n // docs_per_shard)))])
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), n_shards[F.col("source")]).cast("int"))
    rows = _quotas(targets, {s: t for s, (_, t) in sizes.items()}, total_tokens, block)
    if not rows:
        return spark.createDataFrame([], schema)
    shards = docs.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held"))
    quota = shard_quotas(shards, spark.createDataFrame(rows, "mix_name string, source string, blocks long, most int"), block)
    j = docs.join(quota, ["source", "shard"])
    order = Window.partitionBy("mix_name", "source", "shard").orderBy(F.xxhash64("doc_id", "mix_name", F.lit(seed)), "doc_id")
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rounds = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - rounds * F.col("held")
    # a document across the quota's end is taken when more than half of it lies inside
    extra = (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rounds") < F.col("most"))
    return (
        j.withColumn("upto", upto).withColumn("rounds", rounds).withColumn("rest", rest)
        .withColumn("copies", (F.col("rounds") + F.when(extra, 1).otherwise(0)).cast("long"))
        .where("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")
    )


def shares(mixed: DataFrame, mix_target: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, reached_share, tokens, documents, most_copies`` for every target."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    want = mix_target.select("mix_name", source_name(F.col("source")).alias("source"), "target_share").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    j = want.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return j.select("mix_name", "source", "target_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("reached_share"), "tokens", "documents", "most_copies")
