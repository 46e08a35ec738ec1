import random

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.prng import mulberry32
from marginalia.operators import textindex

TOKENS = [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("かなカナ", 4), ("〿" * 4, 1), ("぀" * 4, 4), ("ヿ" * 4, 4), ("㄀" * 4, 1), ("㄰" * 4, 1), ("ㄱ" * 4, 4), ("힣" * 4, 4), ("힤" * 4, 1), ("a b c d e", 5), (" 　", 1), ("😀", 1)]


def test_token_estimates_in_both_engines(spark):
    rows = spark.createDataFrame(TOKENS, "t string, e int").select("t", "e", T.estimate_tokens(F.col("t")).alias("got")).collect()
    for r in rows:
        assert r["got"] == r["e"] == T.estimate(r["t"]), repr(r["t"])


def test_null_text_and_budget(spark):
    df = spark.createDataFrame([(None,)], "t string").select(T.estimate_tokens(F.col("t")).alias("n"), T.fits_budget(F.lit(5), F.lit(None).cast("int")).alias("f"))
    assert tuple(df.first()) == (None, True)


LINES = {
    "": [], "a": [(1, 0, 1, "a", "")], "a\n\n": [(1, 0, 1, "a", "\n"), (2, 2, 2, "", "\n")], "\r\n": [(1, 0, 0, "", "\r\n")],
    "a\r\nb\rc\nd": [(1, 0, 1, "a", "\r\n"), (2, 3, 4, "b", "\r"), (3, 5, 6, "c", "\n"), (4, 7, 8, "d", "")],
    "\n\r": [(1, 0, 0, "", "\n"), (2, 1, 1, "", "\r")], "﻿가\n😀": [(1, 0, 6, "﻿가", "\n"), (2, 7, 11, "😀", "")], "中文\r": [(1, 0, 6, "中文", "\r")],
}


def test_line_map(spark):
    texts = list(LINES)
    got = textindex.lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k", "line").collect()
    for k, t in enumerate(texts):
        assert [tuple(r)[1:] for r in got if r["k"] == k] == LINES[t], repr(t)


def test_line_map_random(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab\r\n😀가 ") for _ in range(rnd.randrange(40))) for _ in range(200)]
    got: dict = {}
    for r in textindex.lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k", "line").collect():
        got.setdefault(r["k"], []).append(r)
    for k, t in enumerate(texts):
        raw = t.encode()
        own = got.get(k, [])
        assert "".join(r["text"] + r["delimiter"] for r in own) == t
        assert all(raw[r["start_byte"] : r["end_byte"]].decode() == r["text"] for r in own)


def test_artifact_null_text(spark):
    a = textindex.artifacts(spark.createDataFrame([(1, "d/x.md", None)], "k int, p string, t string"), "k", "p", "t").first()
    assert (a["byte_length"], a["line_count"]) == (0, 0) and a["label"] == "x.md e3b0c44298fc"


def test_mulberry_is_the_sequential_generator(spark):
    def sequential(seed, n):
        a, out = seed, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append(t ^ (t >> 14))
        return out

    got = [r[0] for r in spark.range(1, 2001).select(mulberry32(F.lit(20260301).cast("long"), F.col("id"))).collect()]
    assert got == sequential(20260301, 2000)
