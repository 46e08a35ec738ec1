import random

import pytest

from marginalia.operators import retrieve as R
from marginalia.operators import summarize


def spans(text, query, budget, k=2, most=5):
    a = R.answer(text, R.query_terms(query), budget, k, most)
    return [(e["start_line"], e["end_line"]) for e in a["excerpts"]], a


def test_defaults_and_omitted():
    got, a = spans("needle\n" * 78, "needle", 10_000, 0)
    assert len(got) == 5 and len(a["omitted"]) == 73 and a["omitted"][:20] == list(range(6, 26))


def test_many_ties_small_budget():
    got, a = spans("needle\n" * 3000, "needle", 100, 2)
    assert got == [(1, 57)] and a["excerpts"][0]["tokens"] == 100 and len(a["omitted"]) == 3000 - 57


def test_long_anchor_then_short():
    text = "needle " * 40 + "\nneedle"
    assert spans(text, "needle", 4)[0] == [(2, 2)]
    got, a = spans(text, "needle", 4, 2, 1)
    assert got == [] and a["reason"] == "source_span_exceeds_budget" and a["omitted"] == [1, 2]


def test_shrinks_and_merges():
    assert spans("x\nx\nx\nneedle\nneedle\nx\nx", "needle", 4, 3)[0] == [(3, 5)]
    lines = ["needle" if i in (2, 6, 8, 12) else "x" for i in range(1, 13)]
    got, a = spans("\n".join(lines), "needle", 40, 1, 2)
    assert got == [(1, 3), (5, 9)] and a["omitted"] == [12]
    got, a = spans("aaaax\n\nx", "x", 2, 1)
    assert got == [(1, 3)] and a["omitted"] == []


def test_fallbacks_and_terms():
    assert R.answer("a", R.query_terms(" ?? "), 10)["reason"] == "no_query_terms"
    assert R.answer("a", R.query_terms("zz"), 10)["reason"] == "no_query_match"
    assert R.answer(None, ["a"], 10)["reason"] == "no_query_match"
    assert R.query_terms("Ａｂ c-d, ‿x") == ["ab", "c-d", "x"]
    for bad in (0, 21, 1.5, True):
        with pytest.raises(ValueError):
            R.check_arguments(bad, 2)


def test_windows_are_the_stepwise_shrink():
    for anchor in range(6):
        for k in range(5):
            for last in range(anchor, 8):
                a, b, seen = max(0, anchor - k), min(last, anchor + k), []
                while True:
                    seen.append((a, b))
                    if a == b:
                        break
                    if anchor - a >= b - anchor and a < anchor:
                        a += 1
                    else:
                        b -= 1
                assert list(R._windows(anchor, k, last)) == seen


def test_costs_are_those_of_the_rendered_text():
    from marginalia.functions.text import estimate

    rnd = random.Random(1)
    for _ in range(200):
        lines = [("".join(rnd.choice("ab 가😀") for _ in range(rnd.randrange(9))), rnd.choice(["\n", "\r\n", "\r"])) for _ in range(6)]
        cost = R._Costs(lines)
        i = rnd.randrange(6)
        j = rnd.randrange(i, 6)
        assert cost(i, j) == estimate("".join(t + d for t, d in lines[i:j]) + lines[j][0])


def test_query_texts_frame(spark):
    df = spark.createDataFrame([(1, "one\nneedle\ntwo", "x"), (2, None, "y"), (3, "", "z")], "k long, t string, excerpts string")
    got = {r["k"]: r for r in R.query_texts(df, "k", "t", "needle", 50).collect()}
    assert got[1]["excerpts"][0]["start_byte"] == 0 and got[1]["excerpts"][0]["end_byte"] == 14
    assert got[2]["fallback_reason"] == got[3]["fallback_reason"] == "no_query_match"


def test_summaries(spark):
    texts = {1: "first line\n\n\t\n", 2: "first line\nsecond", 3: "\nsecond long line of words", 4: "", 5: None, 6: "a\n​", 7: "long line that never fits here at all"}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r["k"]: r for r in summarize.prefix_summaries(df, "k", "t", 3).collect()}
    assert not got[1]["truncated"] and got[2]["truncated"] and got[2]["summary"] == "first line"
    assert (got[4]["tokens"], got[5]["tokens"]) == (0, 0)
    assert got[7]["fallback_reason"] == "summary_span_exceeds_budget"
    zero = {r["k"]: r for r in summarize.prefix_summaries(df, "k", "t", 0).collect()}
    assert (zero[3]["summary"], zero[3]["kept_lines"], zero[3]["tokens"]) == ("", 1, 0)


def test_line_scores_compare_in_nfkc(spark):
    text = "ＰＡＣＫＩＮＧ list\nof\ufb01ce log\npacking 납품서\n\nPacking List"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    query = "packing list office"
    got = {r["line"]: r["score"] for r in R.line_scores(df.where("text is not null"), "doc_id", "text", query).collect()}
    terms = R.query_terms(query)
    assert got == {i: sum(t in R.normalise(x) for t in terms) for i, x in enumerate(text.split("\n"), 1)} and got[1] == 2 and got[2] == 1
    assert R.line_scores(df.limit(0), "doc_id", "text", query).count() == 0
