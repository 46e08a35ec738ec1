import pytest

from marginalia.llm import pairs as P

Q = "What is the batch id on the packing list?"
LONG = "The plan is to read the budget, retrieve the excerpts and then check whatever is left. Nobody asked for more."
CASES = [
    (Q, ["LOT-944022"], "LOT-944022", None), (Q, ["LOT-944022"], "LOT-944023", None), (Q, ["LOT-944022"], None, "empty"), (Q, ["LOT-944022"], " ​\n", "empty"), (Q, ["LOT-944022"], "N/A", "empty"), (Q, ["A-797"], "A-", "truncated"),
    (Q, ["LOT-944022"], "The batch id is LOT-94", "truncated"), (Q, ["18:12"], "18", "truncated"), (Q, ["12:45"], "08:21", None), (Q, ["LOT-944022"], "The batch id that appears", "truncated"), (Q, [LONG], LONG[:60], "truncated"),
    (Q, [LONG], LONG[:-1], None), (Q, [LONG], LONG.split(". ")[0] + ".", None), (Q, [LONG], LONG.split(". ")[0], None), (Q, [LONG], LONG[:50] + "…", "truncated"), (Q, ["LOT-944022"], "Question: " + Q, "copied_question"), (Q, ["LOT-944022"], Q.upper(), "copied_question"),
    (Q, ["LOT-944022"], Q + " LOT-944022", None), (Q, ["LOT-944022"], "Laut dem Dokument: Die Chargennummer ist LOT-944022.", "other_language"), (Q, ["LOT-944022"], "배치 번호는 LOT-944022입니다.", "other_language"), (Q, ["LOT-944022"], "El número de lote es LOT-944022.", "other_language"),
    (Q, ["LOT-944022"], 'It is LOT-944022; the label says "배치 번호".', None), ("배치 번호는 무엇입니까?", ["LOT-944022"], "LOT-944022", None), ("배치 번호는 무엇입니까?", ["hose clamp A12"], "hose clamp A12", None), ("배치 번호는 무엇입니까?", ["LOT-1"], "The batch id is LOT-1.", "other_language"),
    (Q, ["LOT-944022"], "I'm sorry, but I can't help with that request.", "refusal"), (Q, ["LOT-944022"], "정책상 답변을 제공할 수 없습니다.", "refusal"), (Q, ["LOT-944022"], "Sorry for the delay, the batch id is LOT-944022.", None), (Q, [LONG], "A colleague was sorry that the crop cannot be restored, but the history is careful.", None),
    (Q, ["LOT-944022"], "UNREADABLE", None), (Q, None, "LOT-944022", None), (Q, [], "LOT-944022", None), (None, None, "LOT-1", None), (None, None, None, "empty"), (Q, ['"we should read it," said the clerk, "because it matters."'], '"we should read it," said the clerk, "because', "truncated"),
]


@pytest.mark.parametrize("question,gold,answer,want", CASES)
def test_defect(question, gold, answer, want):
    assert P.classify_pair(question, gold, answer) == want


def test_suffix_automaton_finds_runs():
    a = P.SuffixAutomaton("a b c d b c e".split())
    assert a.covered("x b c d y b c e".split(), 3) == [False, True, True, True, False, True, True, True]


def test_refusal_automaton_against_search():
    auto = P.RefusalAutomaton(["abc", "bcd", "c e"])
    for text in ("xxabcd", "bc e", "ab c", "zzbcd", ""):
        ends = [text.find(p) + len(p) for p in ("abc", "bcd", "c e") if p in text]
        assert auto.first_end(text) == (min(ends) if ends else -1)


def test_frame(spark):
    rows = [("a", 1, Q, ["x1"], None, 1, "z"), ("a", 1, Q, ["x1"], "x1", 2, "z"), ("b", 1, Q, None, "", 1, "z"), ("b", 1, Q, None, "", 1, "z"), ("c", 2, Q, ["x1"], "word " * 50_000 + "end.", 1, "z")]
    df = spark.createDataFrame(rows, "attempt_id string, turn int, question string, gold array<string>, answer string, received_at long, defect string")
    assert [tuple(r) for r in P.flag_defects(df).collect()] == [("b", 1, "empty")] and P.flag_defects(df.limit(0)).count() == 0


KO = "배치 번호는 무엇입니까?"
SCRIPTS = [
    (Q, ["LOT-944022"], "写しがなかったので、お知らせは残されませんでした。", "other_language"), (KO, ["LOT-944022"], "バッチ番号はLOT-944022です。", "other_language"), (Q, ["LOT-944022"], "批号是LOT-944022。", "other_language"),
    (Q, ["LOT-944022"], "Номер партии LOT-944022.", "other_language"), (Q, ["LOT-944022"], "رقم الدفعة هو LOT-944022.", "other_language"), (Q, ["LOT-944022"], "หมายเลขล็อตคือ LOT-944022.", "other_language"), (Q, ["LOT-944022"], "Ο αριθμός παρτίδας είναι LOT-944022.", "other_language"),
    ("Batch id?", ["LOT-944022"], "バッチ番号はLOT-944022です。", "other_language"), ("バッチ番号は何ですか？", ["LOT-944022"], "The batch id is LOT-944022.", "other_language"), ("バッチ番号は何ですか？", ["LOT-944022"], "批号是一个四位数字。", "other_language"),
    ("バッチ番号は何ですか？", ["LOT-944022"], "バッチ番号はLOT-944022です。", None), ("バッチ番号は何ですか？", ["LOT-944022"], "LOT-944022", None), ("書類の名前は何ですか？", None, "納品書", None),
    (Q, ["納品書"], "納品書", None), (Q, ["LOT-944022"], "The label 納品書 reads LOT-944022 in the header.", None), (Q, ["5 μF"], "5 μF", None),
]


@pytest.mark.parametrize("question,gold,answer,want", SCRIPTS)
def test_language_by_script(question, gold, answer, want):
    assert P.classify_pair(question, gold, answer) == want
