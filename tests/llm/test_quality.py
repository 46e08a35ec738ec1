import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality as Q

PROSE = "The planner counted several sessions and a few retries, although the prefix had room for fewer. Nobody could move the budget without losing a line, so the reviewer asked for the original."
CASES = {
    "prose": [PROSE, PROSE.replace(", ", ",\n"), "왜 감사팀은 그림을 그대로 두지 않았을까? 이번에는 그림과 예산을 함께 보관했다. 예산을 이미 다 써서 점수를 믿기 어려웠다.", "Planner: " + PROSE, "> " + PROSE, PROSE + "\n\n- one\n- two"],
    "list": ["- read the rubric\n- keep the span\n- move the window", "notes/a/b-1.txt\nnotes/c/d-2.md\nnotes/e/f-3.png", "one_key: off\ntwo_key: 161\nthree_key: auto", "[ ] page numbers\n[x] several readings", "Plain crop and record ........ 144\nLate note and page ........ 12", "a) short crop  b) families  c) late report  d) quiet table", "SESSION — retries\nPREFIX — totals\nANSWER — late sheet", "Five things to keep:\n1. exact report\n2. late table\n3. open questions"],
    "table": ["a,b,c\n1,2,3\n4,5,6\n7,8,9", "| a | b | c |\n|---|---|---|\n| x | 1 | y |", "a\tb\tc\nheld\t3\tok", "2026-05-17T07:43 level=flag req=8ef911 status=ok\n2026-05-12T02:45 level=warn req=fc6c13 status=late", "  28.435   65.148   26.749\n  33.019   69.906   21.159", "x=1 y=2 z=held\nx=4 y=5 z=ok"],
    "junk": ["", None, ".", "​\n", "x5+Ch/HkB7FTCSlM+zM5i/8DibKQKBrBWWe93EdlW0URNJXHYU/RNKFkz2Lh6e/gagzNYqVM\nrFLAhEl8hPRFNBSCSN8vijlXr3JKxwhvkVqh2Y+eNffmLhIyCO7YwvgZ65429t9gHpKLkPYR", ",-~+@ ^ >^{%&|$;=>-\\_&\\|] ,/ ? ^??;;a><^\nb%+^* &_1\\*:+@/>?*@&b$a?%]<-:", "Click here to read on\n" * 20, "a" * 400 + "=" * 300, "<div><span class='a1'></span></div><p><td class='b2'></p>" * 4],
}


def test_types_by_their_patterns():
    texts = [(k, t) for k, ts in CASES.items() for t in ts]
    lines = [Q.statistics(t)[1] for _, t in texts]
    weight: dict = {}
    for x in lines:
        for p, w in x.items():
            weight[p] = weight.get(p, 0) + w
    u = np.array(sorted(weight))
    _, fires, post = Q.learn(u, np.array([weight[p] for p in sorted(weight)], dtype=float))
    of = dict(zip(u.tolist(), post))
    kinds = [Q.KINDS[int(sum(w * of[p] for p, w in x.items()).argmax())] for x in lines]
    wrong = [(k, t, got, x) for (k, t), got, x in zip(texts, kinds, lines) if got != k]
    assert not wrong, wrong
    assert (post.sum(1) == pytest.approx(1)) and ((fires > 0) & (fires < 1)).all()


def test_scrambled_words_are_junk():
    words = (PROSE + " The reviewer kept the page and the table of a quiet planner, and the rest went to the archive.").lower().replace(".", "").replace(",", "").split()
    np.random.default_rng(5).shuffle(words)
    assert "scrambled" in names_of(Q.statistics(" ".join(words))[1]) and "scrambled" not in names_of(Q.statistics(PROSE)[1])


def names_of(lines):
    return {n for p in lines for i, (n, _) in enumerate(Q.FUNCTIONS) if p >> i & 1}


def test_statistics_of_a_known_text():
    v = dict(zip(Q.STATISTICS, Q.statistics("One two.\nThree 4!\n\n")[0]))
    assert (v["n_chars"], v["n_lines"], v["n_words"], v["words_per_line"], v["end_punct_share"]) == (19, 2, 4, 2.0, 1.0)
    assert v["digit_ratio"] == pytest.approx(1 / 14) and v["unique_line_share"] == 1.0


def test_em_recovers_planted_accuracies():
    rnd = np.random.default_rng(3)
    j, own = len(Q.FUNCTIONS), np.array([Q.KINDS.index(c) for _, c in Q.FUNCTIONS])
    true = np.where(own[:, None] == np.arange(4), rnd.uniform(0.4, 0.7, (j, 1)), rnd.uniform(0.01, 0.1, (j, 4)))
    y = rnd.choice(4, 40_000, p=[0.6, 0.15, 0.13, 0.12])
    pats = ((rnd.random((len(y), j)) < true[:, y].T) << np.arange(j)).sum(1)
    u, inv, n = np.unique(pats, return_inverse=True, return_counts=True)
    prior, fires, post = Q.learn(u, n * float(Q.TEXT_WEIGHT))
    assert np.abs(fires - true).mean() < 0.05
    # the posterior beats each function on its own: one that speaks whenever it fires, silence being prose
    right = (post.argmax(1)[inv] == y).mean()
    alone = [(np.where((pats >> i) & 1 == 1, own[i], 0) == y).mean() for i in range(j)]
    assert right > 0.85 and right > max(alone) + 0.1, (right, max(alone))


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(t for ts in CASES.values() for t in ts)]
    got = Q.text_types(spark.createDataFrame(rows, "doc_id long, text string, kind string"))
    assert got.count() == len(rows) and set(Q.STATISTICS) < set(got.columns)
    assert abs(got.select(sum(F.col(f"p_{k}") for k in Q.KINDS).alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9
    assert Q.text_types(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert Q.labelling_functions(spark.createDataFrame(rows, "doc_id long, text string, kind string")).count() == len(Q.FUNCTIONS)
    assert Q.statistics("word " * 200_000 + ".")[0][2] == 200_001
