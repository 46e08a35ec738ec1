"""SQL names for the library's functions, so that plain SQL can use them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from marginalia.functions.text import estimate
from marginalia.operators.policy import N, SEMANTIC_BIT, VISUAL_BIT, fired_rules
from marginalia.operators.retrieve import CONTEXT_LINES, MAX_EXCERPTS, answer, normalise, query_terms


@udtf(returnType="start_line int, end_line int, start_byte bigint, end_byte bigint, tokens int, text string")
class QueryExcerpts:
    """``SELECT * FROM docs, LATERAL query_excerpts(text, 'question', 400)``."""

    def eval(self, text: str, query: str, max_tokens: int) -> Iterator[tuple]:
        for e in answer(text, query_terms(query or ""), max_tokens, CONTEXT_LINES, MAX_EXCERPTS)["excerpts"]:
            yield e["start_line"], e["end_line"], e["start_byte"], e["end_byte"], e["tokens"], e["text"]


def _modes(text: pd.Series) -> pd.Series:
    import pyarrow as pa

    def name(b: int) -> str:
        return "exact" if b & ((1 << N) - 1) else "visual" if b & VISUAL_BIT else "semantic" if b & SEMANTIC_BIT else "unknown"

    return pd.Series([name(b) for b in fired_rules(pa.array(text, pa.string(), from_pandas=True)).to_pylist()])


def _estimates(text: pd.Series) -> pd.Series:
    return text.map(estimate, na_action="ignore").astype("Int32")


def _normal(text: pd.Series) -> pd.Series:
    return text.map(normalise, na_action="ignore")


def register(spark: SparkSession) -> None:
    """Register estimate_tokens, classify_context, normalise_search (Arrow-batched) and query_excerpts."""
    spark.udf.register("estimate_tokens", F.pandas_udf(_estimates, "int"))
    spark.udf.register("classify_context", F.pandas_udf(_modes, "string"))
    spark.udf.register("normalise_search", F.pandas_udf(_normal, "string"))
    spark.udtf.register("query_excerpts", QueryExcerpts)
