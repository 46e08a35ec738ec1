import os
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import mixing, packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=20), st.integers(60, 90))
def test_a_plan_places_everything_once(histogram, capacity):
    p = packing.plan_windows(histogram, capacity)
    used: dict = {}
    for pattern, r in zip(p.patterns, p.repeats):
        assert r > 0 and sum(k * t for k, t in pattern) <= capacity
        for k, t in pattern:
            used[k] = used.get(k, 0) + t * r
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert -(-total // capacity) <= p.windows <= 2 * -(-total // capacity) + 1


def test_least_squares_fits_a_fillable_histogram():
    patterns = [((6, 1), (4, 1)), ((5, 2),), ((3, 2), (4, 1))]
    lengths, counts = np.array([3, 4, 5, 6]), np.array([20.0, 40.0, 14.0, 30.0])
    assert packing.solve_repeats(patterns, lengths, counts) == pytest.approx([30, 7, 10], abs=0.2)


def test_packing_keeps_every_token(spark):
    rnd = random.Random(3)
    sizes = {i: rnd.choice([0, 7, 7, 7, rnd.randrange(1, 900)]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(None, 5, "x")], "doc_id long, n_tokens long, size string")
    win = spark.createDataFrame([("a", 400), ("b", 50), ("zero", 0)], "window_name string, capacity_tokens int")
    got = packing.pack(df.select("doc_id", "n_tokens", "size"), win).collect()
    for name, cap in (("a", 400), ("b", 50)):
        own = [r for r in got if r["window_name"] == name]
        fill: dict = {}
        per: dict = {}
        for r in own:
            fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["size"]
            per.setdefault(r["doc_id"], []).append((r["start"], r["size"]))
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        for i, n in sizes.items():
            parts = sorted(per.get(i, []))
            assert sum(s for _, s in parts) == n and (len(parts) == -(-n // cap))
            assert all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:]))
        assert sum(fill.values()) / (cap * len(fill)) > 0.98
    assert packing.pack(df.limit(0), win).count() == 0


def test_sainte_lague_against_the_plain_rule():
    rnd = random.Random(5)
    for _ in range(200):
        w = {k: rnd.randrange(1, 50) for k in "abcde"[: rnd.randrange(1, 6)]}
        caps = {k: rnd.randrange(0, 30) for k in w}
        n, seats = rnd.randrange(0, 40), dict.fromkeys(w, 0)
        for _ in range(n):
            open_ = [k for k in w if seats[k] < caps[k]]
            if not open_:
                break
            seats[max(open_, key=lambda k: (w[k] / (2 * seats[k] + 1), -ord(k)))] += 1
        got = mixing.sainte_lague(w, n, caps)
        assert sum(got.values()) == sum(seats.values()) and all(got[k] <= caps[k] for k in w)
        if all(c >= 30 for c in caps.values()):
            assert got == seats
        uncapped = mixing.sainte_lague(w, n)
        plain = dict.fromkeys(w, 0)
        for _ in range(n):
            plain[max(w, key=lambda k: (w[k] / (2 * plain[k] + 1), -ord(k)))] += 1
        assert uncapped == plain


def plain_rule(w, n, caps):
    seats = dict.fromkeys(w, 0)
    for _ in range(n):
        open_ = [k for k in w if seats[k] < caps.get(k, n)]
        if not open_:
            break
        k = max(open_, key=lambda k: (Fraction(w[k]) / (2 * seats[k] + 1), -k))
        seats[k] += 1
    return seats


def test_sainte_lague_of_many_keys():
    for small, n in (([0.5] * 1000, 1600), ([0.625] * 12, 500), ([1, 2, 3] * 40, 777)):
        w = {i: x for i, x in enumerate([1000, *small])}
        for caps in ({}, {0: 300, 5: 0}):
            assert mixing.sainte_lague(w, n, caps) == plain_rule(w, n, caps)


def test_shard_quotas_against_the_plain_rule(spark):
    rnd = random.Random(6)
    held = {(s, k): rnd.choice([300, 300, rnd.randrange(1, 9000)]) for s in "ab" for k in range(60)} | {("a", 99): 0}
    shards = spark.createDataFrame([(s, k, t) for (s, k), t in held.items()], "source string, shard int, held long")
    quotas = [("m", "a", 400, 1), ("m", "b", 5000, 2), ("n", "a", 90_000, 1), ("n", "b", 1, 3)]
    got = {(r["mix_name"], r["source"], r["shard"]): r["quota"] for r in mixing.shard_quotas(shards, spark.createDataFrame(quotas, "mix_name string, source string, blocks long, most int"), 256).collect()}
    for m, s, blocks, most in quotas:
        w = {k: t for (x, k), t in held.items() if x == s and t}
        want = plain_rule(w, min(blocks, 3000), {k: -(-t * most // 256) for k, t in w.items()})
        assert {k: min(n * 256, w[k] * most) for k, n in want.items() if n} == {k: q for (x, y, k), q in got.items() if (x, y) == (m, s)}


def test_mix_reaches_its_shares(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["Big_Source", "big source ", "big-source", "small"] if i % 10 else ["tiny"]), rnd.choice([None, "x"]), rnd.randrange(0, 300)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, share string, n_tokens long")
    target = spark.createDataFrame([("m", "big-source", 0.5, 2), ("m", "small", 0.3, 3), ("m", "tiny", 0.2, 4), ("e", "nowhere", 1.0, 1), ("m2", "tiny", 0.9, 1), ("m2", "nowhere", 0.1, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix(df, target, docs_per_shard=300)
    s = {(r["mix_name"], r["source"]): r for r in mixing.shares(got, target).collect()}
    for k, want in ((("m", "big-source"), 0.5), (("m", "small"), 0.3), (("m", "tiny"), 0.2)):
        assert s[k]["reached_share"] == pytest.approx(want, abs=0.01)
    assert s["m", "tiny"]["most_copies"] <= 4 and s["m", "big-source"]["most_copies"] <= 2
    assert s["e", "nowhere"]["reached_share"] == 0 and s["m2", "tiny"]["reached_share"] == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df, target, docs_per_shard=300).collect()))
    assert mixing.mix(df.limit(0), target).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")
def test_token_counts(spark):
    texts = ["", None, "hello world", "가나다", "a" * 50_000, "<|endoftext|>"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    enc = tokens.encoder(open(tokens.TOKENIZER, "rb").read())
    assert got[0] == got[1] == 0 and got[2] == 2
    for i, t in enumerate(texts[2:], 2):
        ids = enc.encode_ordinary(t)
        assert got[i] == len(ids) and enc.decode(ids) == t


def test_least_squares_places_most_windows():
    rnd = np.random.default_rng(4)
    for capacity, mean in ((400, 90), (2000, 300), (500, 2)):
        sizes, n = np.unique(np.clip(rnd.lognormal(np.log(mean), 0.8, 20_000).astype(int), 1, capacity), return_counts=True)
        h = dict(zip(sizes.tolist(), n.tolist()))
        p = packing.plan_windows(h, capacity)
        tokens_ = sum(k * v for k, v in h.items())
        assert p.solved * capacity > 0.9 * tokens_ and p.windows <= 1.005 * tokens_ / capacity + 1
