import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import sessions
from marginalia.evals import dataset, ledger, schedule
from marginalia.stats import robust


def test_ordered_sum_in_every_order(spark):
    for p in itertools.permutations([1e16, 1.0, 1.0]):
        df = spark.createDataFrame([(x,) for x in p], "c double").repartition(3)
        assert df.agg(ledger.ordered_sum(F.col("c"))).first()[0] == 1.0000000000000002e16


def test_arm_without_runs(spark):
    runs = spark.createDataFrame([("a", "success", 1.0, 5.0), ("a", "failure", 2.0, 7.0)], "arm string, outcome string, cost double, latency double")
    arms = spark.createDataFrame([("a",), ("b",)], "arm string")
    r = {x["arm"]: x for x in ledger.arm_report(runs, arms, 2).collect()}
    assert (r["a"]["success_rate"], r["a"]["total_cost"], r["a"]["cost_per_success"], r["a"]["median_latency"]) == (0.5, 3.0, 3.0, 5.0)
    assert (r["b"]["missing"], r["b"]["success_rate"], r["b"]["total_cost"], r["b"]["median_latency"]) == (2, 0.0, None, None)


def test_outcomes(spark):
    rows = [("failed", True, [True], False, None, "failure"), ("completed", False, None, None, None, "ungraded"), ("completed", True, [], False, None, "success"), ("completed", True, [True, False], False, None, "failure"), ("completed", True, [True], True, None, "failure"), ("completed", True, [True], False, False, "failure"), ("completed", True, [True], False, True, "success")]
    df = spark.createDataFrame(rows, "s string, j boolean, c array<boolean>, x boolean, e boolean, want string")
    for r in df.withColumn("got", ledger.outcome(*[F.col(c) for c in "sjcxe"])).collect():
        assert r["got"] == r["want"]


def test_ledger_errors_come_in_order(spark):
    tasks = spark.createDataFrame([("t", ["f"], "exact")], "task_id string, required_facts array<string>, category string")
    arms = spark.createDataFrame([("a",)], "arm string")
    kind = "task_id string, arm string, attempt int, status string, judgment struct<covered_facts:array<boolean>,exact_check_passed:boolean>"
    good = ("t", "a", 1, "completed", ([True], True))
    ledger.check_ledger(spark.createDataFrame([good], kind), tasks, arms, 3)
    for rows, code in (([("u", "a", 1, "completed", None), good, good], "out_of_plan"), ([good, good], "duplicate_run"), ([("t", "a", 1, "completed", ([True], None))], "judgment_shape")):
        with pytest.raises(ValueError, match=code):
            ledger.check_ledger(spark.createDataFrame(rows, kind), tasks, arms, 3)


def plan_of(spark, families, category="factual", languages=("en", "ko")):
    return spark.createDataFrame([(f, f"{f}-{x}", x, category) for f in families for x in languages], "family string, task string, language string, category string")


def test_paired_families(spark):
    rows = [("f1", "r", "success")] * 3 + [("f1", "r", "failure")] * 3 + [("f1", "c", "success")] * 6 + [("f2", "r", "success")] * 6 + [("f2", "c", "failure")] * 6
    kind, plan, arms = "family string, arm string, outcome string", plan_of(spark, ["f1", "f2"]), ["r", "c"]
    f = ledger.paired_success(spark.createDataFrame(rows, kind), plan, arms, "r", "c")
    assert {r["family"]: (r["reference_rate"], r["comparison_rate"], r["difference"]) for r in f.collect()} == {"f1": (0.5, 1.0, 0.5), "f2": (1.0, 0.0, -1.0)}
    assert tuple(ledger.point_estimate(f).first()) == (2, -0.25)
    for short in (rows[1:], [("f1", "r", "ungraded"), *rows[1:]]):
        f = ledger.paired_success(spark.createDataFrame(short, kind), plan, arms, "r", "c")
        assert f.count() == 0 and tuple(ledger.point_estimate(f).first()) == (0, None)
    for bad, code in ((dict(arms=["r"]), "missing_contrast_arm"), (dict(attempts=2), "unsupported_analysis_attempts"), (dict(tasks=plan_of(spark, ["f1"], languages=("en", "de"))), "invalid_analysis_family"), (dict(tasks=plan_of(spark, range(10_000))), "analysis_capacity_exceeded")):
        with pytest.raises(ValueError, match=code):
            ledger.paired_success(**(dict(outcomes=spark.createDataFrame(rows, kind), tasks=plan, arms=arms, reference="r", comparison="c") | bad))


def test_derived_arms(spark):
    kind = "arm string, key string, family string, question string, condition string, matched boolean, outcome string, answer string, correct boolean, tokens long, cost double"
    base = [("C", f"k{i}", "f", f"q{i}", "x", m, o, a, False, 10, 1.0) for i, (m, o, a) in enumerate([(True, "answered", "It is UNREADABLE"), (False, "answered", "unreadable"), (True, "answered", "7"), (True, "failed", None), (True, "answered", "unreadable")])]
    orig = [("A", f"a{i}", "f", f"q{i}", "x", None, "answered", "9", True, 5, 2.0) for i in range(4)] + [("A", "b0", "f", "q0", "x", None, "answered", "later", False, 1, 1.0)]
    g = spark.createDataFrame(base + orig, kind)
    of = lambda by: {r["key"]: (r["outcome"], r["answer"], r["correct"], r["tokens"], r["cost"], r["fallback"]) for r in ledger.fallback_arm(g, "C", "A", "D", by).collect()}
    both = ("answered", "9", True, 15, 3.0, "unreadable")
    assert of(False) == {"k0": both, "k1": both, "k2": ("answered", "7", False, 10, 1.0, None), "k3": ("failed", None, False, 10, 1.0, None), "k4": ("answered", "unreadable", False, 10, 1.0, None)}
    assert of(True) == of(False) | {"k1": ("answered", "9", True, 5, 2.0, "no_window"), "k4": ("not_started", "unreadable", False, 10, 1.0, None)}
    means = ledger.fallback_arm(g, "C", "A", "D", True).agg(ledger.started_mean(F.col("outcome"), F.col("correct")))
    assert means.first()[0] == 0.5


def test_ranks_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", rnd.choice([1.0, 2.0, rnd.random() * 9]), i) for i in range(900)] + [(None, 1.0, 900), ("one", None, 901)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    got = {(r["k"], r["i"]): (r["_rank"], r["_n"]) for r in robust.ranked(df, ["k"], ["v", "i"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[k, r[2]] for r in own] == [(x, len(own)) for x in range(len(own))]
    q = {r["k"]: r for r in robust.order_statistics(robust.ranked(df, ["k"], ["v", "i"]), ["k"], "v", {"p": 0.95}, {"q": 0.3}).collect()}
    hot = np.array([r[1] for r in rows if r[0] == "hot"])
    assert q["hot"]["p"] == np.sort(hot)[int(np.ceil(0.95 * len(hot))) - 1] and q["hot"]["q"] == pytest.approx(np.quantile(hot, 0.3))
    d = {r["k"]: r for r in robust.drift(df.where("k = 'hot'"), ["k"], ["i"], "v").collect()}["hot"]
    by = [r[1] for r in rows if r[0] == "hot"]
    half = -(-len(by) // 2)
    assert (d["early"], d["late"]) == (pytest.approx(np.mean(by[:half])), pytest.approx(np.mean(by[half:])))


FIRST = [((10, 100, 100, 11, 10, 4), ("request_timeout", 10, 0, None, 1)), ((10, 10, 100, 10, 10, 4), ("run_timeout", 10, 0, None, 1)), ((10, 100, 9, 1, 10, 4), ("budget_exhausted", 0, 0, 0, 0)), ((10, 100, 100, 1, 10, None), ("unknown_cost", 1, 0, None, 1)), ((10, 100, 100, 1, 10, 11), ("reservation_exceeded", 1, 11, 11, 1))]


@pytest.mark.parametrize("given,want", FIRST)
def test_first_stop(spark, given, want):
    req, run, cap, duration, reserve, settle = given
    o = spark.createDataFrame([(1, 1, "completed", duration, reserve, settle)], "k int, ordinal int, status string, duration long, reserved long, settled long")
    r = schedule.simulate(o, ["k"], req, run, cap).first()
    assert (r["stop_reason"], r["elapsed_ms"], r["known_cost"], r["settled_cost"], r["started"]) == want


def brute(rows, req, run, cap):
    t = c = started = 0
    for duration, reserved, settled in rows:
        if t >= run:
            return "run_timeout", t, c, started
        if reserved > cap - c:
            return "budget_exhausted", t, c, started
        started += 1
        limit = min(req, run - t)
        if duration >= limit:
            return ("run_timeout" if run - t <= req else "request_timeout"), t + limit, c, started
        t += duration
        if settled is None:
            return "unknown_cost", t, c, started
        c += settled
        if settled > reserved:
            return "reservation_exceeded", t, c, started
    return "schedule_exhausted", t, c, started


def test_simulation_against_a_loop(spark):
    rnd = random.Random(3)
    runs = {k: [(rnd.randrange(12), rnd.randrange(9), rnd.choice([None] + [rnd.randrange(9)] * 9)) for _ in range(rnd.randrange(1, 12))] for k in range(400)}
    rows = [(k, i + 1, "completed", *x) for k, v in runs.items() for i, x in enumerate(v)]
    o = spark.createDataFrame(rows, "k int, ordinal int, status string, duration long, reserved long, settled long")
    for r in schedule.simulate(o, ["k"], 10, 40, 25).collect():
        assert (r["stop_reason"], r["elapsed_ms"], r["known_cost"], r["started"]) == brute(runs[r["k"]], 10, 40, 25)


def test_seeded_arm_order(spark):
    tasks = spark.createDataFrame([("f", "t", "en")], "family string, task string, language string")
    a = schedule.schedule(tasks, ["x", "y", "z"], 3, "sha256-rank-v1", "0" * 64).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in a] == list(range(1, 10)) and [r["attempt"] for r in a] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    with pytest.raises(ValueError, match="slot_limit"):
        schedule.schedule(spark.range(20_000).selectExpr("'f' family", "cast(id as string) task", "'en' language"), ["a", "b"], 3, "x", "y")


def test_dataset_issues(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(0, "a", "f", "train", "exact", "exact", "é\r\nx", sha("é\r\nx")), (1, "a", "f", "test", "exact", "semantic", "q", "bad"), (2, "c", "g", "train", "x", "y", "é\nx", sha("é\nx"))]
    got = {(r["idx"], r["code"]) for r in dataset.dataset_issues(spark.createDataFrame(rows, "idx long, id string, family_id string, split string, category string, rubric_kind string, source_text string, source_sha256 string")).collect()}
    assert got == {(1, "rubric_category_mismatch"), (1, "source_hash_mismatch"), (1, "duplicate_id"), (1, "family_split_leakage"), (2, "source_family_conflict")}


def test_exact_checks_take_the_first_code(spark):
    t = "task_id string, category string, rubric_kind string, check_id string, record_sha256 string, source_sha256 string, source_text string"
    tasks = spark.createDataFrame([("ok", "exact", "exact", "c", "r", "s", "x\nline"), ("drift", "exact", "exact", "c", "other", "s", "x\nline"), ("src", "exact", "exact", "c", "r", "s2", "x\nline"), ("kind", "fact", "exact", "c", "r", "s", "x\nline")], t)
    reg = spark.createDataFrame([("c", k, "r", "s", 1, "line") for k in ("ok", "drift", "src", "kind")], "check_id string, task_id string, record_sha256 string, source_sha256 string, source_line int, excerpt string")
    env = spark.createDataFrame([("ok", "line", "d"), ("drift", "line", "d"), ("src", "line", "d"), ("kind", "line", "d"), ("none", "line", "d")], "task_id string, response_text string, dataset_sha256 string")
    got = {r["task_id"]: (r["code"], r["passed"]) for r in ledger.exact_checks(env, tasks, reg, "d").collect()}
    assert got == {"ok": (None, True), "drift": ("registry_drift", None), "src": ("source_fidelity_failure", None), "kind": ("unsupported_task", None), "none": ("unsupported_task", None)}


def test_bootstrap_against_a_loop(spark):
    d = [0.5, -0.25, 1 / 6, 0.0, -1 / 3]
    m = robust.bootstrap_means(spark.createDataFrame(list(enumerate(d)), "j long, d double"), 50, 9)
    a, out = 9, []
    for _ in range(50):
        s = 0.0
        for _ in range(len(d)):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            s += d[int((t ^ (t >> 14)) / 4294967296 * len(d))]
        out.append(s / len(d))
    assert [r["mean"] for r in m.orderBy("i").collect()] == out
    ci = robust.interval(m, 50).first()
    assert (ci["lo"], ci["hi"]) == (sorted(out)[1], sorted(out)[48])


def test_content_match(spark):
    rows = [("The answer is **On**.", ["on"], True), ("on or off", ["on"], False), ("It costs 1,234 now", ["1234"], True), ("12345", ["1234"], False), ("January", ["jan"], True), ("the code is AB-1.", ["ab-1"], True), (None, ["x"], False), ("x", None, False), ("x", [], False), ("b", ["a", "b"], True)]
    df = spark.createDataFrame(rows, "a string, g array<string>, want boolean")
    for r in df.withColumn("got", sessions.matches_gold(F.col("a"), F.col("g"))).collect():
        assert r["got"] == r["want"], r


def test_latest_wins(spark):
    rows = [("a", 1, "ok"), ("a", 2, "failed"), ("b", 1, "failed"), ("b", 2, "failed"), ("c", 1, "ok"), ("c", 2, "ok")]
    got = {r["k"]: r["seq"] for r in sessions.latest_wins(spark.createDataFrame(rows, "k string, seq int, status string"), "k", "seq").collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
