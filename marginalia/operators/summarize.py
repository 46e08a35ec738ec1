"""Extractive prefix summaries: the longest run of first lines that fits a token budget.

Defined results: lines are joined with LF; omitted lines of white space don't count as truncation; a
text without lines has an empty summary of 0 tokens; when not even the first line fits there is no
summary and a fallback reason.  Only texts classified as semantic may be summarised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import CJK_JAVA, WS_JAVA
from marginalia.operators.policy import mode_of, rule_bits
from marginalia.operators.textindex import Lines, line_texts

# Fallback reason by class of content.
FALLBACK = {"exact": "exact_content_requires_source", "visual": "visual_content_requires_source", "unknown": "unknown_content_requires_source"}
SUMMARY = "n_lines long, kept_lines long, summary string, tokens int, truncated boolean, fallback_reason string"


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _summarised(raw: pa.Array, max_tokens: int) -> list[pa.Array]:
    """The columns of ``SUMMARY`` for a batch of texts, given as lists of lines."""
    n = Lines(raw)
    beyond = _count(n.text, r"[\x{10000}-\x{10FFFF}]")
    units = n.running(pc.utf8_length(n.text).to_numpy(zero_copy_only=False) + beyond) + np.arange(len(n.of)) - n.first[n.of]  # joined with LF
    cjk, words = n.running(_count(n.text, f"[{CJK_JAVA}]")), n.running(_count(n.text, f"[^{WS_JAVA}]+"))
    tokens = np.where(units == 0, 0, np.maximum(np.maximum(1, words), -(-(units - cjk) // 4) + cjk))
    fits = tokens <= max_tokens
    size = len(n.counts)
    kept = np.bincount(n.of, fits, size).astype(np.int64)
    left = ~fits & pc.match_substring_regex(n.text, f"[^{WS_JAVA}]").to_numpy(zero_copy_only=False)
    truncated = (kept > 0) & (np.bincount(n.of, left, size) > 0)
    most = np.zeros(size, dtype=np.int32)
    np.maximum.at(most, n.of[fits], tokens[fits].astype(np.int32))
    offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
    summary = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), n.text.filter(pa.array(fits))), "\n")
    reason = pa.array(np.where((kept == 0) & (n.counts > 0), "summary_span_exceeds_budget", None), pa.string())
    return [pa.array(n.counts), pa.array(kept), summary, pa.array(most), pa.array(truncated), reason]


def _run(docs: DataFrame, key: str, text: str, max_tokens: int, mode: Column) -> DataFrame:
    """One pass over texts in their rows; texts of another mode than semantic give their fallback only."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocked = pc.not_equal(b.column(2), "semantic")
            counts, kept, summary, tokens, truncated, reason = _summarised(pc.if_else(blocked, pa.scalar(None, b.column(1).type), b.column(1)), max_tokens)
            why = pa.array([FALLBACK.get(m) for m in b.column(2).to_pylist()], pa.string())
            counts = pc.if_else(blocked, pa.scalar(None, pa.int64()), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), counts, kept, summary, tokens, truncated, pc.if_else(blocked, why, reason)], names=[key, "n_lines", "kept_lines", "summary", "tokens", "truncated", "fallback_reason"])

    rows = docs.select(key, line_texts(F.coalesce(F.col(text), F.lit(""))).alias("_raw"), mode.alias("_mode"))
    return rows.mapInArrow(run, f"`{key}` {kind}, {SUMMARY}")


def prefix_summaries(docs: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """``key, n_lines, kept_lines, summary, tokens, truncated, fallback_reason``.

    Costs grow along the lines, so the kept prefix is found by counting; nothing is shuffled.
    """
    return _run(docs, key, text, max_tokens, F.lit("semantic"))


def gated_summaries(docs: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """Summaries of semantic texts; the others get the fallback of their class and no summary (``n_lines`` is null)."""
    return _run(docs, key, text, max_tokens, mode_of(rule_bits(F.col(text))))
