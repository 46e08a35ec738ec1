import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import sessions
from marginalia.functions.register import register
from marginalia.operators import images
from marginalia.stats import robust


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "one\nneedle\ntwo"), (2, None), (3, "token: x")], "k int, t string").createOrReplaceTempView("d")
    got = {r["k"]: (r["n"], r["m"], r["z"]) for r in spark.sql("SELECT k, estimate_tokens(t) n, classify_context(t) m, normalise_search(t) z FROM d").collect()}
    assert got == {1: (4, "unknown", "one\nneedle\ntwo"), 2: (None, "unknown", None), 3: (2, "exact", "token: x")}
    e = spark.sql("SELECT k, e.* FROM d, LATERAL query_excerpts(t, 'needle', 50) e").collect()
    assert [(r["k"], r["start_line"], r["end_line"]) for r in e] == [(1, 1, 3)]


def test_slots_and_words(spark):
    rows = [("the answer is EU region", ["eu"], True, True), ("in EU west", ["eu"], False, True), (None, ["x"], False, False), ("x", None, False, False)]
    df = spark.createDataFrame(rows, "a string, g array<string>, s boolean, c boolean")
    for r in df.select("s", "c", sessions.strict_match(F.col("a"), F.col("g")).alias("gs"), sessions.content_match(F.col("a"), F.col("g")).alias("gc")).collect():
        assert (r["gs"], r["gc"]) == (r["s"], r["c"])
    w = spark.createDataFrame([("batch", ["batches", "id"]), ("bat", ["batches"]), ("id", ["id"])], "w string, ws array<string>")
    assert [r[0] for r in w.select(sessions.fuzzy_hit(F.col("w"), F.col("ws"))).collect()] == [True, False, True]


def test_block_bootstrap_against_a_loop(spark):
    blocks = [[1.0, 1.1], [0.9, 1.0], [1.2, 1.3]]
    m = robust.block_bootstrap(spark.createDataFrame([("r", blocks), ("none", []), ("null", None)], "k string, b array<array<double>>"), "k", "b", 30, 11)
    a, want = 11, []
    for _ in range(30):
        pick = []
        for _ in range(3):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            pick += blocks[int((t ^ (t >> 14)) / 4294967296 * 3)]
        want.append(float(np.median(pick)))
    assert [tuple(r) for r in m.collect()] == [("r", pytest.approx(1.05), pytest.approx(np.quantile(want, 0.025)), pytest.approx(np.quantile(want, 0.975)))]
    got = robust.ratio_bootstrap([1.0, 2.0, 4.0], [1.1, 2.0, 4.8], 7, 200)
    x, y, draws = np.array([1.0, 2.0, 4.0]), np.array([1.1, 2.0, 4.8]), robust.lcg(7, 600)
    picks = [[int(u * 3) for u in draws[3 * k : 3 * k + 3]] for k in range(200)]
    paired = sorted(np.median([y[i] / x[i] for i in p]) for p in picks)
    assert got["paired_ci"] == [round(paired[5], 4), round(paired[194], 4)] and got["paired_ratio"] == 1.1 and got["median_ratio"] == 1.0
    assert sorted(robust.seeded_shuffle(range(20), 5)) == list(range(20)) and robust.seeded_shuffle(range(20), 5) == robust.seeded_shuffle(range(20), 5)


def test_regions_and_changed_sources(spark):
    df = spark.createDataFrame([(5, 5, 100, 100), (95, 50, 100, 100), (50, 50, 20, 20)], "x int, y int, w int, h int")
    got = [tuple(r[0]) for r in df.select(images.region_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 40, 40)).collect()]
    assert got == [(0, 0, 40, 40), (60, 30, 40, 40), (0, 0, 20, 20)]
    lines = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 2, 2, 0.9), ("a", 3, 1, 1.0), ("b", 1, 0, 1.0)], "k string, line_no int, hits int, confidence double")
    assert [(r["k"], r["line_no"]) for r in images.best_line(lines, ["k"]).collect()] == [("a", 2)]
    files = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary")
    index = files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_length"))
    now = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"3"))], "path string, content binary")
    assert {r["path"]: r["state"] for r in images.reinspect(index, now).collect()} == {"p": "same", "q": "source_changed"}
