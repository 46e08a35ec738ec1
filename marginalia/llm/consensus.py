"""Consensus of several annotators' labels by iteratively reweighted voting.

Votes are weighted by what each annotator's label is worth, the consensus of *the other* annotators
of an item re-estimates those weights, and so on until no annotator's accuracy moves.  The weight of
a vote is the log-likelihood of the voted label under each true label, estimated from leave-one-out
consensus with smoothing toward the annotator's own overall accuracy.  That keeps a rater who always
says the most frequent label from counting as accurate: their vote has the same likelihood under
every truth.  ``krippendorff_alpha`` reports chance-corrected agreement with missing ratings.

Up to ``MAX_ANNOTATORS`` annotators, a round is one pass of NumPy blocks over the items' ballots with
the weight table broadcast, and only cells of that table travel.  Beyond, weights and votes are
joined and all sums are plain aggregates.  Both run the same arithmetic.

Defined results: labels that are null or outside of the item's codebook cast no vote; spelling
variants (case, blanks, hyphens, trailing stops) count as the codebook's spelling; of several labels
by one rater for one item the last valid one (by ``rated_at``, then ``rating_id``) counts; items
without a vote get the most frequent label of their kind; ties go to the codebook's first label;
weights that still move after ``MAX_ROUNDS`` rounds are used and a warning says so.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import cut

# The codebook.
CODEBOOK = {
    "response": ["correct", "silent_wrong", "explicit_uncertain", "incomplete", "other_wrong", "indeterminate"],
    "summary": ["retained", "omitted", "contradicted", "unassessable"],
}
KINDS, SIZES = list(CODEBOOK), [len(x) for x in CODEBOOK.values()]
WIDTH = max(SIZES)
SMOOTHING = 6.0
START_ACCURACY = 0.7
MAX_ROUNDS = 200
TOLERANCE = 0.002
#: Annotators up to which the weight table is broadcast and its cells are collected.
MAX_ANNOTATORS = 5_000
SCALE = 1 << 24
#: Log-likelihood of what can't be.
NEVER = -1e9
ADJUDICATOR = "adjudicator"


def _plain(label: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[.\s]+$", ""), r"[\s_-]+", "_")


def _place(plain: Column, kind: str) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, CODEBOOK[kind])), plain), F.lit(0)).cast("int") - 1


def label_index(label: Column, kind: Column) -> Column:
    """Position (from 0) of a label in the codebook of its kind; null for anything else."""
    plain = _plain(label)
    out = F.lit(None).cast("int")
    for k in CODEBOOK:
        out = F.when(kind == k, _place(plain, k)).otherwise(out)
    return out


def label_name(index: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, names in CODEBOOK.items():
        out = F.when(kind == k, F.get(F.array(*map(F.lit, names)), index)).otherwise(out)
    return out


def items(verify: DataFrame) -> DataFrame:
    """One row per item (the last verification) with its three recorded labels as indexes."""
    rec = F.struct("kind", "claude_label", "openai_label", "final_label", "adjudicated")
    one = verify.where("item_id is not null").groupBy("item_id").agg(F.max_by(rec, F.struct("verified_at", F.xxhash64("final_label", "adjudicated"))).alias("v"))
    kind = F.col("v.kind")
    return one.select(
        "item_id",
        kind.alias("kind"),
        *[label_index(F.col(f"v.{c}_label"), kind).alias(c) for c in ("claude", "openai", "final")],
        F.col("v.adjudicated").alias("adjudicated"),
    )


def votes(verify: DataFrame, rating: DataFrame) -> DataFrame:
    """``item_id, kind, annotator, voted`` (codebook index), at most one row per item and annotator.

    A final label that was not adjudicated only repeats the two first labels that agreed: it fills a
    missing first label and casts no vote of its own.
    """
    it = items(verify)
    repeats = (F.coalesce(F.col("adjudicated"), F.lit(0)) != 1) & F.col("final").isNotNull()
    agreed = repeats & (F.coalesce(F.col("claude"), F.col("final")) == F.col("final")) & (F.coalesce(F.col("openai"), F.col("final")) == F.col("final"))
    first = F.array(
        F.struct(F.lit("claude").alias("annotator"), F.when(agreed, F.col("final")).otherwise(F.col("claude")).alias("voted")),
        F.struct(F.lit("openai").alias("annotator"), F.when(agreed, F.col("final")).otherwise(F.col("openai")).alias("voted")),
        F.struct(F.lit(ADJUDICATOR).alias("annotator"), F.when(~agreed, F.col("final")).alias("voted")),
    )
    recorded = it.select("item_id", "kind", F.explode(first).alias("x")).select("item_id", "kind", "x.annotator", "x.voted")
    # both kinds' indexes at once, so that ratings are reduced before they meet their items
    r = rating.where("item_id is not null and rater_id is not null").select("item_id", "rater_id", "rated_at", "rating_id", _plain("label").alias("plain"))
    order = F.struct("rated_at", "rating_id")
    aggs = [F.max_by(_place(F.col("plain"), k), F.when(_place(F.col("plain"), k).isNotNull(), order)).alias(k) for k in CODEBOOK]
    by_rater = r.groupBy("item_id", "rater_id").agg(*aggs)
    voted = F.lit(None).cast("int")
    for k in CODEBOOK:
        voted = F.when(F.col("kind") == k, F.col(k)).otherwise(voted)
    rated = by_rater.join(it.select("item_id", "kind"), "item_id").select("item_id", "kind", F.col("rater_id").alias("annotator"), voted.alias("voted"))
    return recorded.unionByName(rated).where("voted is not null")


# ---------------------------------------------------------------- arithmetic of a round


def start_weights() -> np.ndarray:
    """``[kind, voted, truth]`` of the first round: everybody is right with ``START_ACCURACY``."""
    out = np.full((len(KINDS), WIDTH, WIDTH), NEVER)
    for i, k in enumerate(SIZES):
        out[i, :k, :k] = math.log((1 - START_ACCURACY) / (k - 1))
        out[i, range(k), range(k)] = math.log(START_ACCURACY)
    return out


def weights_of(cells: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(w[a, voted, truth], accuracy[a])`` from leave-one-out counts ``cells`` of the same form and votes ``n[a]``."""
    c = cells[:, :k, :k]
    accuracy = (np.trace(c, axis1=1, axis2=2) + SMOOTHING * 0.6) / (n + SMOOTHING)
    own = np.einsum("all->al", c)
    wrong = c.sum(2) - own
    off = 1 - accuracy[:, None]
    miss = off * (wrong + 1) / (n[:, None] * off + k)
    guess = np.repeat(miss[:, :, None], k, axis=2)
    guess[:, range(k), range(k)] = accuracy[:, None]
    w = np.full((len(n), WIDTH, WIDTH), NEVER)
    w[:, :k, :k] = np.log((c + SMOOTHING * guess) / (c.sum(1)[:, None, :] + SMOOTHING))
    return w, accuracy


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _prior(counts: np.ndarray, n: float, k: int) -> np.ndarray:
    out = np.full(WIDTH, NEVER)
    out[:k] = np.log((counts[:k] + 1) / (n + k))
    return out


# ---------------------------------------------------------------- few annotators: blocks


@dataclass(frozen=True)
class Table:
    """Weights ``w[kind, annotator, voted, truth]`` and priors ``[kind, truth]``, with what they rest on."""

    w: np.ndarray
    prior: np.ndarray
    n: np.ndarray
    accuracy: np.ndarray


def _block(batch: pa.RecordBatch, table: Table) -> tuple[np.ndarray, ...]:
    """``(kind, at, annotator, voted, w, scores)``: the batch's items, and its votes with their item's place ``at``."""
    kind = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
    ballot = batch.column("ballot")
    at = np.repeat(np.arange(batch.num_rows), np.diff(ballot.offsets.to_numpy()))
    coded = ballot.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    who, voted = coded // WIDTH, coded % WIDTH
    w = table.w[kind[at], who, voted]
    scores = table.prior[kind].copy()
    for t in range(WIDTH):
        scores[:, t] += np.bincount(at, w[:, t], batch.num_rows)
    return kind, at, who, voted, w, scores


def _count(ballots: DataFrame, table: Table, n_annotators: int) -> np.ndarray:
    """Leave-one-out counts ``[kind, annotator or prior, voted, truth or votes]`` over all items.

    Probabilities are summed as whole multiples of 1/SCALE, so neither the order of partitions nor a
    repeated task changes a bit.
    """
    spark = ballots.sparkSession
    shape = (len(KINDS), n_annotators + 1, WIDTH, WIDTH + 1)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64).ravel()
        for b in batches:
            kind, at, who, voted, w, scores = _block(b, shared.value)
            for row, p in (((kind[at] * shape[1] + who) * WIDTH + voted, softmax(scores[at] - w)), ((kind * shape[1] + n_annotators) * WIDTH, softmax(scores))):
                whole = np.rint(p * SCALE).astype(np.int64)
                for t in range(WIDTH):
                    np.add.at(total, row * (WIDTH + 1) + t, whole[:, t])
                np.add.at(total, row * (WIDTH + 1) + WIDTH, 1)
        cell = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    out = np.zeros(shape, dtype=np.int64).ravel()
    for r in ballots.select("kind", "ballot").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row per cell
        out[r["cell"]] = r["n"]
    shared.unpersist()
    return out.reshape(shape)


def _learn(ballots: DataFrame, n_annotators: int, max_rounds: int, tolerance: float) -> Table:
    start = np.broadcast_to(start_weights()[:, None], (len(KINDS), n_annotators, WIDTH, WIDTH))
    mask = np.array([[0.0 if t < k else NEVER for t in range(WIDTH)] for k in SIZES])
    table = Table(np.ascontiguousarray(start), mask, np.zeros((len(KINDS), n_annotators)), np.full((len(KINDS), n_annotators), np.inf))
    moved = math.inf
    for _ in range(max_rounds):
        counts = _count(ballots, table, n_annotators)
        got = [weights_of(counts[i, :-1, :, :WIDTH] / SCALE, counts[i, :-1, :, WIDTH].sum(1), k) for i, k in enumerate(SIZES)]
        prior = np.stack([_prior(counts[i, -1, 0, :WIDTH] / SCALE, counts[i, -1, 0, WIDTH], k) for i, k in enumerate(SIZES)])
        new = Table(np.stack([w for w, _ in got]), prior, counts[:, :-1, :, WIDTH].sum(2), np.stack([a for _, a in got]))
        moved = np.abs(new.accuracy - table.accuracy)[new.n > 0].max(initial=0.0)
        table = new
        if moved < tolerance:
            break
    _told(moved, tolerance, max_rounds)
    return table


def _told(moved: float, tolerance: float, rounds: int) -> None:
    if moved >= tolerance:
        warnings.warn(f"accuracies still move by {moved:.4f} after {rounds} rounds", stacklevel=3)


def _judged(ballots: DataFrame, table: Table) -> DataFrame:
    """``item_id, kind, best, confidence, n_votes, agreement`` of the items that have votes."""
    shared = ballots.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, at, _, voted, _, scores = _block(b, shared.value)
            p = softmax(scores)
            best = p.argmax(1)
            n = np.bincount(at, minlength=b.num_rows)
            same = np.bincount(at, voted == best[at], b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), pa.array([KINDS[i] for i in kind]), pa.array(best.astype(np.int32)), pa.array(p.max(1)), pa.array(n.astype(np.int32)), pa.array(same / n)],
                names=["item_id", "kind", "best", "confidence", "n_votes", "agreement"],
            )

    return ballots.mapInArrow(run, "item_id long, kind string, best int, confidence double, n_votes int, agreement double")


# ---------------------------------------------------------------- many annotators: joins


def _joined_scores(voted: DataFrame, weights: DataFrame, prior: DataFrame) -> DataFrame:
    """Votes with their weights ``w``, and scores ``s`` of their items (sums, so a hot item combines map-side)."""
    w = voted.join(weights.select("kind", "annotator", "voted", "w"), ["kind", "annotator", "voted"])
    sums = w.groupBy("item_id").agg(*[F.sum(F.get("w", F.lit(t))).alias(f"s{t}") for t in range(WIDTH)])
    j = w.join(sums, "item_id").join(F.broadcast(prior), "kind")  # one row per kind
    return j.select("item_id", "kind", "annotator", "voted", "w", F.array(*[F.col(f"s{t}") + F.get("prior", F.lit(t)) for t in range(WIDTH)]).alias("s"))


def _softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _joined_weights(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = scored.withColumn("p", _softmax(F.zip_with("s", "w", lambda a, b: a - b)))
    cells = [F.sum(F.when(F.col("voted") == l, F.get("p", F.lit(t))).otherwise(0.0)) for l in range(WIDTH) for t in range(WIDTH)]
    per = own.groupBy("kind", "annotator").agg(F.count("*").alias("n"), F.array(*cells).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, g in pdf.groupby("kind"):
                k = SIZES[KINDS.index(kind)]
                w, accuracy = weights_of(np.array(g["cells"].tolist()).reshape(-1, WIDTH, WIDTH), g["n"].to_numpy(float), k)
                yield pd.DataFrame({"kind": kind, "annotator": g["annotator"].repeat(k), "n": g["n"].repeat(k), "accuracy": accuracy.repeat(k), "voted": np.tile(np.arange(k), len(g)), "w": w[:, :k].reshape(-1, WIDTH).tolist()})

    weights = cut(per.mapInPandas(run, "kind string, annotator string, n long, accuracy double, voted int, w array<double>"))
    whole = scored.groupBy("item_id", "kind").agg(F.first("s").alias("s")).withColumn("p", _softmax(F.col("s")))
    sums = whole.groupBy("kind").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("p", F.lit(t))) for t in range(WIDTH)]).alias("c")).collect()
    rows = [(r["kind"], _prior(np.array(r["c"]), r["n"], SIZES[KINDS.index(r["kind"])]).tolist()) for r in sums]
    return weights, voted_prior(scored.sparkSession, rows)


def voted_prior(spark, rows: list[tuple[str, list[float]]]) -> DataFrame:
    return spark.createDataFrame(rows, "kind string, prior array<double>")


def _learn_joined(voted: DataFrame, max_rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    first = start_weights()
    rows = [(kind, l, first[i, l].tolist()) for i, (kind, k) in enumerate(zip(KINDS, SIZES)) for l in range(k)]
    start = F.broadcast(voted.sparkSession.createDataFrame(rows, "kind string, voted int, w array<double>"))  # one row per label
    weights = voted.select("kind", "annotator").distinct().join(start, "kind").withColumn("accuracy", F.lit(None).cast("double"))
    prior = voted_prior(voted.sparkSession, [(kind, [0.0 if t < k else NEVER for t in range(WIDTH)]) for kind, k in zip(KINDS, SIZES)])
    moved = math.inf
    for turn in range(max_rounds):
        before = weights
        weights, prior = _joined_weights(_joined_scores(voted, weights, prior))
        if turn:
            was = before.where("voted = 0").select("kind", "annotator", F.col("accuracy").alias("was"))
            moved = weights.where("voted = 0").join(was, ["kind", "annotator"]).agg(F.max(F.abs(F.col("accuracy") - F.col("was")))).first()[0] or 0.0
        if moved < tolerance:
            break
    _told(moved, tolerance, max_rounds)
    return weights, prior


def _judged_joined(voted: DataFrame, weights: DataFrame, prior: DataFrame) -> DataFrame:
    s = _joined_scores(voted, weights, prior).withColumn("p", _softmax(F.col("s"))).withColumn("best", F.array_position("p", F.array_max("p")).cast("int") - 1)
    per = s.groupBy("item_id", "kind").agg(F.first("best").alias("best"), F.first(F.array_max("p")).alias("confidence"), F.count("*").cast("int").alias("n_votes"), F.avg((F.col("voted") == F.col("best")).cast("double")).alias("agreement"))
    return per


# ---------------------------------------------------------------- operators


def reweight(voted: DataFrame, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, max_annotators: int = MAX_ANNOTATORS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(judged items, reliability, usual)`` once no annotator's accuracy moves by ``tolerance``.

    ``judged``: ``item_id, kind, best, confidence, n_votes, agreement``; ``reliability``: ``kind, annotator,
    n_votes, accuracy``; ``usual``: the most frequent label of each kind and its share.
    """
    spark = voted.sparkSession
    voted = cut(voted)
    names = [r["annotator"] for r in voted.select("annotator").distinct().limit(max_annotators + 1).collect()]
    if len(names) > max_annotators:
        weights, prior = _learn_joined(voted, max_rounds, tolerance)
        reliability = weights.where("voted = 0").select("kind", "annotator", F.col("n").alias("n_votes"), "accuracy")
        return _judged_joined(voted, weights, prior), reliability, prior.select("kind", (F.array_position("prior", F.array_max("prior")).cast("int") - 1).alias("usual"), F.exp(F.array_max("prior")).alias("share"))
    names.sort()
    codes = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator string, code long")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    # at most one vote per annotator, so a ballot has at most max_annotators entries
    ballots = cut(voted.join(F.broadcast(codes), "annotator").groupBy("item_id", kind.alias("kind")).agg(F.sort_array(F.collect_list(F.col("code") * WIDTH + F.col("voted"))).alias("ballot")))
    table = _learn(ballots, len(names), max_rounds, tolerance)
    reliability = [(k, a, int(table.n[i, j]), float(table.accuracy[i, j])) for i, k in enumerate(KINDS) for j, a in enumerate(names) if table.n[i, j]]
    usual = [(k, int(table.prior[i].argmax()), float(np.exp(table.prior[i].max()))) for i, k in enumerate(KINDS) if table.n[i].sum()]
    return (
        _judged(ballots, table),
        spark.createDataFrame(reliability, "kind string, annotator string, n_votes long, accuracy double"),
        spark.createDataFrame(usual, "kind string, usual int, share double"),
    )


def consensus(verify: DataFrame, rating: DataFrame, **options) -> DataFrame:
    """``item_id, kind, label, confidence, n_votes, agreement`` for each item of ``verify``."""
    judged, _, usual = reweight(votes(verify, rating), **options)
    every = items(verify).select("item_id", "kind").join(judged.drop("kind"), "item_id", "left").join(F.broadcast(usual), "kind", "left")  # one row per kind
    return every.select(
        "item_id",
        "kind",
        label_name(F.coalesce("best", "usual", F.lit(0)), F.col("kind")).alias("label"),
        F.coalesce("confidence", "share").alias("confidence"),
        F.coalesce("n_votes", F.lit(0)).alias("n_votes"),
        "agreement",
    )


def annotators(verify: DataFrame, rating: DataFrame, **options) -> DataFrame:
    """Reliability of each annotator by kind: votes, leave-one-out accuracy, and that above chance."""
    _, reliability, _ = reweight(votes(verify, rating), **options)
    k = F.when(F.col("kind") == "summary", F.lit(len(CODEBOOK["summary"]))).otherwise(F.lit(len(CODEBOOK["response"])))
    return reliability.select("kind", "annotator", "n_votes", "accuracy", ((F.col("accuracy") - 1 / k) / (1 - 1 / k)).alias("above_chance"))


def krippendorff_alpha(voted: DataFrame) -> DataFrame:
    """``kind, n_units, n_values, observed, expected, alpha``: nominal alpha over items with two votes or more."""
    per = voted.groupBy("item_id", "kind", "voted").agg(F.count("*").alias("n"))
    units = per.groupBy("item_id", "kind").agg(F.sum("n").alias("m"), F.collect_list(F.struct("voted", "n")).alias("cells")).where("m > 1")
    same = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * (c["n"] - 1.0))
    totals = units.groupBy("kind").agg(
        F.count("*").alias("n_units"),
        F.sum("m").alias("n_values"),
        F.sum((F.col("m") * (F.col("m") - 1.0) - same) / (F.col("m") - 1.0)).alias("apart"),
    )
    share = units.select("kind", F.explode("cells").alias("c")).groupBy("kind", "c.voted").agg(F.sum("c.n").alias("n"))
    squares = share.groupBy("kind").agg(F.sum(F.col("n") * (F.col("n") - 1.0)).alias("alike"))
    n = F.col("n_values")
    return totals.join(squares, "kind").select(
        "kind",
        "n_units",
        "n_values",
        F.round(F.col("apart") / n, 6).alias("observed"),
        F.round(1 - F.col("alike") / (n * (n - 1.0)), 6).alias("expected"),
        F.round(1 - (F.col("apart") / n) / (1 - F.col("alike") / (n * (n - 1.0))), 6).alias("alpha"),
    )
