"""Budgeted excerpts that answer a key-word query, with line and byte evidence.

A line's score is the number of query terms (duplicates counted) that its normalised text contains;
all lines with the best score are anchors.  Excerpts are whole lines around anchors, each shrunk
until the token budget holds, merged where they overlap.

The cost of lines i..j comes from prefix sums (UTF-16 units, CJK units, words, delimiter units), so
every probe is O(1).  A window of l lines before and r after its anchor shrinks from its longer side
(ties from the front); with T = l + r lines left that is l = max(T - r0, min(l0, T // 2)).

Defined results: a query without terms and a text without a match give a fallback reason and no
excerpt; null texts are empty texts; budgets may be 0; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.evals.dataset import nfkc_lower
from marginalia.functions.text import measures, tokens_from
from marginalia.operators.textindex import split_lines

MAX_EXCERPTS, CONTEXT_LINES, LISTED = 5, 2, 20
_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r)|([^\r\n]+)")


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def _is_term(ch: str, first: bool) -> bool:
    c = unicodedata.category(ch)[0]
    return c in "LN" or ch in "_./:-" or not first and c == "M"


def query_terms(query: str) -> list[str]:
    """Terms of a query in order, duplicates kept."""
    terms, cur = [], ""
    for ch in normalise(query):
        if _is_term(ch, not cur):
            cur += ch
        else:
            if cur:
                terms.append(cur)
            cur = ch if _is_term(ch, True) else ""
    return [*terms, cur] if cur else terms


def check_arguments(max_excerpts: int, context_lines: int) -> None:
    if isinstance(max_excerpts, bool) or not isinstance(max_excerpts, int) or not 1 <= max_excerpts <= 20:
        raise ValueError("maxExcerpts must be an integer from 1 to 20")
    if isinstance(context_lines, bool) or not isinstance(context_lines, int) or not 0 <= context_lines <= 2**53 - 1:
        raise ValueError("contextLines must be a non-negative safe integer")


def line_scores(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key, line, score`` of every line, JVM-side; only lines with a character outside of ASCII are brought to NFKC, in Arrow batches."""
    terms = query_terms(query)
    low = F.coalesce(nfkc_lower(F.when(F.col("text").rlike(r"[^\x00-\x7F]"), F.col("text"))), F.lower("text"))
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return split_lines(docs, key, text).select(key, "line", "text", "delimiter", score.alias("score"))


def best_lines(scores: DataFrame, key: str) -> DataFrame:
    """Anchors: the lines of each text that reach its best score above 0 (an aggregate and a join-free window)."""
    return scores.where("score > 0").withColumn("best", F.max("score").over(Window.partitionBy(key))).where("score = best").drop("best")


class _Costs:
    """Token costs of runs of lines by prefix sums."""

    def __init__(self, lines: list[tuple[str, str]]) -> None:
        m = [measures(t) for t, _ in lines]
        self.units, self.cjk, self.words = ([0, *accumulate(x)] for x in zip(*m)) if m else ([0], [0], [0])
        self.ends = [0, *accumulate(len(d) for _, d in lines)]

    def __call__(self, i: int, j: int) -> int:
        units = self.units[j + 1] - self.units[i] + self.ends[j] - self.ends[i]
        return tokens_from(units, self.cjk[j + 1] - self.cjk[i], self.words[j + 1] - self.words[i])


def _windows(anchor: int, k: int, last: int) -> Iterator[tuple[int, int]]:
    """Ever smaller windows around an anchor."""
    before, after = min(k, anchor), min(k, last - anchor)
    for total in range(before + after, -1, -1):
        left = max(total - after, min(before, total // 2))
        yield anchor - left, anchor + total - left


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined; adjacent ones stay apart."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def choose_spans(anchors: list[int], cost: _Costs, n_lines: int, budget: int, k: int, most: int) -> list[tuple[int, int]]:
    """Accepted line spans (0-based, inclusive), in order."""
    last = n_lines - 1
    first = next((w for w in _windows(anchors[0], k, last) if cost(*w) <= budget), None)
    spans = [first] if first else []
    if most == 1:
        return spans
    spent = sum(cost(*s) for s in spans)
    for a in anchors[1:]:
        end = spans[-1][1] if spans else -1
        if len(spans) >= most and a - k > end:
            break
        if any(x <= a <= y for x, y in spans):
            continue
        if max(0, a - k) > end and cost(a, a) > budget - spent:
            continue  # a window apart from all others costs at least its anchor
        for lo, hi in _windows(a, k, last):
            touches = any(lo <= y and hi >= x for x, y in spans)
            if not touches and len(spans) >= most:
                continue
            joined = _union([*spans, (lo, hi)])
            total = sum(cost(*s) for s in joined)
            if total <= budget:
                spans, spent = joined, total
                break
    return spans


def answer(text: str | None, terms: list[str], budget: int, k: int = CONTEXT_LINES, most: int = MAX_EXCERPTS) -> dict:
    """The whole response for one text: spans, excerpt texts, byte evidence, omitted matches, fallback."""
    lines = [(m[1] or m[3] or "", m[2] or "") for m in _LINE.finditer(text or "")]
    if not terms:
        return {"reason": "no_query_terms", "warning": "query_has_no_searchable_terms", "excerpts": [], "omitted": []}
    low = [normalise(t) for t, _ in lines]
    scores = [sum(t in s for t in terms) for s in low]
    best = max(scores, default=0)
    if best <= 0:
        return {"reason": "no_query_match", "warning": "query_terms_not_found", "excerpts": [], "omitted": []}
    anchors = [i for i, s in enumerate(scores) if s == best]
    cost = _Costs(lines)
    spans = choose_spans(anchors, cost, len(lines), budget, k, most)
    omitted = [a + 1 for a in anchors if not any(x <= a <= y for x, y in spans)]
    if not spans:
        return {"reason": "source_span_exceeds_budget", "warning": "complete_span_required", "excerpts": [], "omitted": omitted if len(anchors) > 1 else []}
    starts = [0, *accumulate(len((t + d).encode("utf-8", "surrogatepass")) for t, d in lines)]
    excerpts = []
    for a, b in spans:
        body = "".join(t + d for t, d in lines[a:b]) + lines[b][0]
        excerpts.append({"text": body, "start_line": a + 1, "end_line": b + 1, "start_byte": starts[a], "end_byte": starts[b] + len(lines[b][0].encode("utf-8", "surrogatepass")), "tokens": cost(a, b)})
    return {"reason": None, "warning": None, "excerpts": excerpts, "omitted": omitted}


RESPONSE = (
    "estimated_tokens int, fallback_reason string, warning string, more_count int, more_lines array<int>, "
    "excerpts array<struct<text:string,start_line:int,end_line:int,start_byte:bigint,end_byte:bigint,tokens:int>>"
)


def query_texts(docs: DataFrame, key: str, text: str, query: str, max_tokens: int, context_lines: int = CONTEXT_LINES, max_excerpts: int = MAX_EXCERPTS) -> DataFrame:
    """One response row per text.  Texts never leave their row, so there is no shuffle at any size."""
    check_arguments(max_excerpts, context_lines)
    terms = query_terms(query)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {RESPONSE}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[key], pdf[text]):
                r = answer(t, terms, max_tokens, context_lines, max_excerpts)
                rows.append((i, sum(e["tokens"] for e in r["excerpts"]), r["reason"], r["warning"], len(r["omitted"]) or None, r["omitted"][:LISTED] or None, r["excerpts"]))
            out = pd.DataFrame(rows, columns=[key, "estimated_tokens", "fallback_reason", "warning", "more_count", "more_lines", "excerpts"])
            yield out.astype({"estimated_tokens": "int32", "more_count": "Int32"})

    return docs.select(key, text).mapInPandas(run, schema)


def excerpts_of(responses: DataFrame, key: str) -> DataFrame:
    return responses.select(key, F.posexplode("excerpts").alias("_i", "e")).select(key, (F.col("_i") + 1).alias("excerpt_no"), "e.*")


def keyword_variant(question: Column, stop_words: list[str]) -> Column:
    """The question's words without stop words and trailing ``. : ?``, joined by blanks."""
    words = F.transform(F.split(question, r"\s+"), lambda w: F.regexp_replace(w, r"[.:?]+$", ""))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(stop_words)), " ")


def entity_variant(question: Column) -> Column:
    """The words with a digit, or null without one."""
    words = F.transform(F.split(question, r"\s+"), lambda w: F.regexp_replace(w, r"[.:?]+$", ""))
    found = F.filter(words, lambda w: w.rlike("[0-9]"))
    return F.when(F.size(found) > 0, F.array_join(found, " "))
