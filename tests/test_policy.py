import time

import pyarrow as pa
import pytest

from marginalia.operators import policy as P

CASES = [
    ("Note: preserve source text exactly before compression.", "semantic", ["natural_language"]),
    ("<a   Note: }", "unknown", ["insufficient_semantic_signal"]),
    ("apikey = x", "exact", ["secret"]),
    ("비밀번호: x", "exact", ["secret"]),
    ("sudo -u root npm install", "exact", ["code_or_path"]),
    ("request handling", "exact", ["identifier_or_hash", "code_or_path"]),
    ("eventually", "unknown", ["insufficient_semantic_signal"]),
    ("A screenshot of it all", "visual", ["visual_context"]),
    ("| a | b |\n| c | d |\n", "exact", ["numeric_or_table"]),
    ("There were 12 of them.", "exact", ["numeric_or_table"]),
    ("SELECT a FROM b", "exact", ["code_syntax"]),
    ("", "unknown", ["insufficient_semantic_signal"]),
    (None, "unknown", ["insufficient_semantic_signal"]),
    ("The quiet reader kept every page in the usual order.\r\nNobody asked why the pages were kept.", "semantic", ["natural_language"]),
    ("A LOUD VOICE spoke to everyone who was here.", "unknown", ["insufficient_semantic_signal"]),
]


def test_modes_and_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "k int, t string")
    got = {r["k"]: r for r in P.classify(df, "k", "t").collect()}
    for i, (t, mode, reasons) in enumerate(CASES):
        assert (got[i]["mode"], got[i]["reasons"]) == (mode, reasons), t
        assert got[i]["lossy_allowed"] == (mode == "semantic") and got[i]["warnings"] == P.WARNINGS[mode]


@pytest.mark.parametrize("text", ["a." * 50_000, "DROP " * 20_000, "a-" * 50_000, "ab" * 50_000, "|x\n" * 30_000, "sudo -x " * 20_000, "<!" * 50_000, "{" * 100_000, "a/" * 50_000])
def test_adversarial_texts_are_linear(text):
    began = time.time()
    P.fired_rules(pa.array([text]))
    assert time.time() - began < 5
