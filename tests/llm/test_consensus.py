import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import consensus as C

V = "item_id long, kind string, claude_label string, openai_label string, final_label string, adjudicated int, verified_at long, label string"
R = "rating_id long, item_id long, rater_id string, label string, rated_at long, kind string"


def frames(spark, verify, rating):
    return spark.createDataFrame([(*v, 0, "x") for v in verify], V), spark.createDataFrame([(*r, "x") for r in rating], R)


def test_spellings_and_invalid_labels(spark):
    rows = [(" Silent-Wrong. ", "response", 1), ("CORRECT", "response", 0), ("retained", "response", None), ("retained.", "summary", 0), (None, "summary", None), ("n/a", "response", None), ("", "response", None), ("other  wrong", "response", 4)]
    df = spark.createDataFrame(rows, "l string, k string, w int")
    for r in df.withColumn("got", C.label_index(F.col("l"), F.col("k"))).collect():
        assert r["got"] == r["w"], r


def test_one_vote_per_rater_and_repeats(spark):
    v, r = frames(spark, [(1, "response", "correct", None, "correct", 0), (2, "response", "correct", "incomplete", "incomplete", 1), (1, "response", "correct", None, "correct", 0)],
                  [(1, 1, "a", "incomplete", 1), (1, 1, "a", "incomplete", 1), (2, 1, "a", "correct", 2), (3, 1, "a", "see note", 3), (4, 9, "a", "correct", 1)])
    got = sorted((x["item_id"], x["annotator"], x["voted"]) for x in C.votes(v, r).collect())
    assert got == [(1, "a", 0), (1, "claude", 0), (1, "openai", 0), (2, "adjudicator", 3), (2, "claude", 0), (2, "openai", 3)]


def test_every_item_gets_a_label(spark):
    v, r = frames(spark, [(1, "summary", None, None, None, None), (2, "summary", "omitted", "omitted", "omitted", 0)], [])
    got = {x["item_id"]: (x["label"], x["n_votes"]) for x in C.consensus(v, r).collect()}
    assert got == {1: ("omitted", 0), 2: ("omitted", 2)}
    assert C.consensus(*frames(spark, [], [])).count() == 0


def test_recovers_planted_truth_better_than_majority(spark):
    rnd = random.Random(4)
    book = C.CODEBOOK["response"]
    skill = {f"r{i}": a for i, a in enumerate([0.95, 0.9, 0.9, 0.5, 0.4, 0.2, 0.2])}
    truth, verify, rating, k = {}, [], [], 0
    votes: dict = {}
    for i in range(700):
        t = truth[i] = rnd.choices(book, [5, 2, 2, 1, 1, 1])[0]
        say = lambda a: t if rnd.random() < a else rnd.choice([x for x in book if x != t])  # noqa: E731, B023
        a, b = say(0.7), say(0.65)
        verify.append((i, "response", a, b, None, None))
        votes[i] = [a, b]
        for name in rnd.sample(list(skill), 4):
            k += 1
            label = say(skill[name])
            rating.append((k, i, name, label, k))
            votes[i].append(label)
        k += 1
        rating.append((k, i, "yes-man", "correct", k))
        votes[i].append("correct")
    v, r = frames(spark, verify, rating)
    got = {x["item_id"]: x["label"] for x in C.consensus(v, r).collect()}
    right = sum(got[i] == truth[i] for i in truth) / len(truth)
    plain = sum(max(book, key=lambda b: (votes[i].count(b), -book.index(b))) == truth[i] for i in truth) / len(truth)
    assert right > 0.8 and right > plain + 0.03, (right, plain)
    acc = {x["annotator"]: x["accuracy"] for x in C.annotators(v, r).collect()}
    assert acc["r0"] > 0.75 and acc["r5"] < 0.4


def test_alpha_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, "response", f"a{j}", rnd.choice([0, 0, 1, 2])) for i in range(40) for j in range(rnd.randrange(4))]
    got = C.krippendorff_alpha(spark.createDataFrame(rows, "item_id long, kind string, annotator string, voted int")).first()
    units = [u for u in ([v for i, _, _, v in rows if i == k] for k in range(40)) if len(u) > 1]
    flat = [v for u in units for v in u]
    do = sum(sum(a != b for x, a in enumerate(u) for y, b in enumerate(u) if x != y) / (len(u) - 1) for u in units) / len(flat)
    de = sum(a != b for x, a in enumerate(flat) for y, b in enumerate(flat) if x != y) / (len(flat) * (len(flat) - 1))
    assert got["alpha"] == pytest.approx(1 - do / de, abs=1e-5) and got["n_values"] == len(flat)


def test_joined_rounds_equal_blocks(spark):
    rnd = random.Random(8)
    say = lambda kind: rnd.choice([*C.CODEBOOK[kind], None, "see note"])
    kinds = {i: rnd.choice(["response", "response", "summary", "odd", None]) for i in range(150)}
    verify = [(i, k, say(k or "summary") if k != "odd" else "correct", "correct", "correct", i % 2) for i, k in kinds.items()]
    rating = [(n, n % 150, f"r{rnd.randrange(9)}", say(kinds[n % 150] if kinds[n % 150] in C.CODEBOOK else "response"), n) for n in range(600)]
    v, r = frames(spark, verify, rating)
    near = lambda rows: sorted((x["item_id"], x["kind"] or "", x["label"] or "", round(x["confidence"] or 0, 4), x["n_votes"], round(x["agreement"] or 0, 6)) for x in rows)
    assert near(C.consensus(v, r).collect()) == near(C.consensus(v, r, max_annotators=3).collect())
    many = {(x["kind"], x["annotator"]): (x["n_votes"], pytest.approx(x["accuracy"], abs=1e-5)) for x in C.annotators(v, r, max_annotators=3).collect()}
    assert {(x["kind"], x["annotator"]): (x["n_votes"], x["accuracy"]) for x in C.annotators(v, r).collect()} == many
    with pytest.warns(UserWarning, match="after 1 rounds"):
        C.consensus(v, r, max_rounds=1)
