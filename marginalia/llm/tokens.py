"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the rank file of the byte-level BPE vocabulary is; a parameter, never copied.
TOKENIZER = os.environ.get("MARGINALIA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before merges, as the vocabulary's publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[int, object] = {}


def encoder(ranks_file: bytes):
    """The encoder of a rank file's bytes, made once per process."""
    key = hash(ranks_file)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def count_tokens(enc, text: str | None) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    try:
        return len(enc.encode_ordinary(text))
    except UnicodeEncodeError:
        return len(enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns + n_tokens``.  The vocabulary (0.5 MB whatever the data) goes to the workers by broadcast."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(*columns, "text")
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            sizes = pa.array([count_tokens(enc, t) for t in b.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], sizes], [*columns, "n_tokens"])

    return rows.mapInArrow(run, schema)
