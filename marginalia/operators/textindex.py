"""Content-addressed artifacts and their lines with exact UTF-8 byte offsets.

Defined results: null texts give an artifact without lines; ``''`` has 0 lines; CRLF, lone CR and
lone LF end a line; a byte order mark stays in the text; there is no phantom line after a final end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def artifact_id(path: Column, sha: Column) -> Column:
    return F.concat(F.lit("artifact_"), F.substring(F.sha2(F.encode(F.concat(path, F.lit("\0"), sha), "utf-8"), 256), 1, 16))


def artifact_label(path: Column, sha: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)[/\\]*\z", 1)
    return F.concat(base, F.lit(" "), F.substring(sha, 1, 12))


def line_texts(text: Column) -> Column:
    """Array of lines, each with its own delimiter."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def artifacts(docs: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``key, artifact_id, sha256, label, byte_length, line_count`` per text."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(key, F.col(path).alias("_path"), t.alias("_text"), content_hash(t).alias("sha256"))
    return d.select(
        key, artifact_id(F.col("_path"), F.col("sha256")).alias("artifact_id"), "sha256", artifact_label(F.col("_path"), F.col("sha256")).alias("label"),
        F.octet_length("_text").cast("long").alias("byte_length"), F.size(line_texts(F.col("_text"))).cast("long").alias("line_count"),
    )


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, text, delimiter`` without offsets: a projection, no shuffle."""
    each = docs.select(key, F.posexplode(line_texts(F.col(text))).alias("_i", "_raw"))
    delimiter = F.regexp_extract("_raw", r"(\r\n|\r|\n)\z", 1)
    return each.select(key, (F.col("_i") + 1).alias("line"), F.regexp_replace("_raw", r"(?:\r\n|\r|\n)\z", "").alias("text"), delimiter.alias("delimiter"))


class Lines:
    """The lines of an Arrow batch of texts, flattened: their text ``of`` places, delimiters and UTF-8 offsets."""

    def __init__(self, raw: pa.Array) -> None:
        raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
        self.counts = pc.fill_null(pc.list_value_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.of = np.repeat(np.arange(len(raw)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.raw = pc.list_flatten(raw)
        self.text = pc.replace_substring_regex(self.raw, r"(?:\r\n|\r|\n)\z", "")
        whole, body = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.raw, self.text))
        self.start = self.running(whole) - whole
        self.end = self.start + body
        ends = whole - body
        last_cr = pc.ends_with(self.raw, "\r").to_numpy(zero_copy_only=False)
        self.delimiter = pa.array(np.where(ends == 2, "\r\n", np.where(ends == 0, "", np.where(last_cr, "\r", "\n"))), pa.string())

    def running(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` from each text's first line to each line."""
        total = np.cumsum(values)
        before = np.concatenate([[0], total])[self.first]
        return total - before[self.of]


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, start_byte, end_byte, text, delimiter``: offsets add up inside each text's row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Lines(b.column(1))
            number = np.arange(len(n.of)) - n.first[n.of] + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(n.of)), pa.array(number.astype(np.int32)), pa.array(n.start), pa.array(n.end), n.text, n.delimiter],
                names=[key, "line", "start_byte", "end_byte", "text", "delimiter"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, line_texts(F.col(text)).alias("_raw")).mapInArrow(run, f"`{key}` {kind}, line int, start_byte bigint, end_byte bigint, text string, delimiter string")
