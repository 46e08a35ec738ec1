import random

import pytest

from marginalia.llm import digest as D

S = "sample_id long, series_id long, name string, shard int, measured_at timestamp, received_at timestamp, latency_ms double, v string"


def samples(spark, n=4000, seed=2):
    import datetime as dt

    rnd = random.Random(seed)
    t0 = dt.datetime(2026, 3, 1)
    rows = []
    for i in range(n):
        name = "hot" if rnd.random() < 0.4 else f"n{i % 7}"
        v = rnd.choice([None, -1.0, float("nan")]) if rnd.random() < 0.03 else round(rnd.lognormvariate(3, 1), 1)
        row = (i, i % 2, f" {name.upper()} " if rnd.random() < 0.2 else name, i % 5, t0 + dt.timedelta(days=i % 4), t0 + dt.timedelta(days=5, seconds=i), v, "x")
        rows.append(row)
        if rnd.random() < 0.05:
            rows.append((*row[:5], t0 + dt.timedelta(days=9), *row[6:]))
    return spark.createDataFrame(rows, S), rows


def exact(rows):
    seen, groups = {}, {}
    for r in sorted(rows, key=lambda r: r[5]):
        if r[6] is not None and r[6] == r[6] and r[6] >= 0:
            seen.setdefault(r[0], r)
    for r in seen.values():
        groups.setdefault((r[1], r[2].strip().lower()), []).append(r[6])
    return groups


def off(vals, x, at):
    lo, hi = 100 * sum(v < x for v in vals) / len(vals), 100 * sum(v <= x for v in vals) / len(vals)
    return max(lo - at, at - hi, 0)


def test_certified_error_is_the_true_error(spark):
    df, rows = samples(spark)
    by_name: dict = {}
    for (_, n), vals in exact(rows).items():
        by_name.setdefault(n, []).extend(vals)
    got = D.certified_percentiles(D.clean_samples(df), ["name"]).collect()
    assert len(got) == 2 * len(by_name)
    for r in got:
        assert r["n"] == len(by_name[r["name"]])
        assert r["rank_error"] == pytest.approx(off(by_name[r["name"]], r["value"], 100 * r["q"]), abs=1e-9) and r["rank_error"] < 1.5


def test_merged_digests_stay_within_bounds(spark):
    df, rows = samples(spark)
    by_name: dict = {}
    for (_, n), vals in exact(rows).items():
        by_name.setdefault(n, []).extend(vals)
    daily = D.build_digests(D.clean_samples(df), ["name", "day", "shard"])
    for r in D.percentiles(D.merge_digests(daily, ["name"], ["day", "shard"]), ["name"]).collect():
        vals = by_name[r["name"]]
        below, upto = sum(v < r["value"] for v in vals), sum(v <= r["value"] for v in vals)
        assert r["below_least"] <= below <= r["below_most"] and r["upto_least"] <= upto <= r["upto_most"]
        assert off(vals, r["value"], 100 * r["q"]) < 3


def test_wrong_reports_against_brute_force(spark):
    df, rows = samples(spark)
    rnd, reports, want = random.Random(8), [], set()
    for k, ((s, n), vals) in enumerate(sorted(exact(rows).items()) * 6):
        srt = sorted(vals)
        m = srt[min(len(srt) - 1, int(len(srt) * rnd.choice([0.5, 0.5, 0.515, 0.53, 0.47, 0.6])))]
        p = rnd.choice([None, srt[min(len(srt) - 1, int(len(srt) * rnd.choice([0.95, 0.965, 0.98])))]])
        reports += [(k, s, n.upper(), m, p)] * (2 if k % 9 == 0 else 1)
        if off(vals, m, 50) > 2 or p is not None and off(vals, p, 95) > 2:
            want.add(k)
    reports.append((9999, 77, "nobody", 1.0, 1.0))
    rep = spark.createDataFrame(reports, "report_id long, series_id long, name string, median_latency_ms double, p95_latency_ms double")
    assert want and sorted(r[0] for r in D.wrong_reports(rep, df, delta=20).collect()) == sorted(want)


def test_null_days_form_no_group(spark):
    from pyspark.sql import functions as F

    df, _ = samples(spark, 300)
    some = df.withColumn("measured_at", F.when(F.col("sample_id") % 2 == 0, F.col("measured_at")))
    got = D.certified_percentiles(D.clean_samples(some), ["name", "day"])
    n = D.clean_samples(some).where("day is not null").count()
    assert got.where("q = 0.5").agg({"n": "sum"}).first()[0] == n and got.where("day is null").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert D.certified_percentiles(D.clean_samples(df), ["name"]).count() == 0
