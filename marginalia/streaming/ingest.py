"""Stateless streaming ingest: index and classify texts as they arrive, append results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions.text import estimate_tokens
from marginalia.operators.policy import mode_of, rule_bits
from marginalia.operators.textindex import artifact_id, content_hash, line_texts


def index_stream(docs: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Works on a stream or a batch: every column depends on its own row only."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(key, F.col(path).alias("_path"), t.alias("_t"), content_hash(t).alias("sha256"))
    return d.select(key, artifact_id(F.col("_path"), F.col("sha256")).alias("artifact_id"), "sha256", F.size(line_texts(F.col("_t"))).alias("line_count"), estimate_tokens(F.col("_t")).alias("tokens"), mode_of(rule_bits(F.col("_t"))).alias("mode"))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """File stream to Parquet with exactly-once appends; resumes from its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return index_stream(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
