"""Queries of the training-data operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import consensus, digest, mixing, packing, pairs, quality, secrets, tokens
from marginalia.runtime import cut, ship, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tokens.token_sizes(_documents(spark, d, *columns), columns=("doc_id", *columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "verify"), table(spark, d, "rating")).select("item_id", "label")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "verify"), table(spark, d, "rating"))


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotators(table(spark, d, "verify"), table(spark, d, "rating"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.krippendorff_alpha(consensus.votes(table(spark, d, "verify"), table(spark, d, "rating")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return digest.wrong_reports(table(spark, d, "run_report"), table(spark, d, "run_sample"))


def _certified(*keys: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        samples = table(spark, d, "run_sample")
        salts = digest.salts_for(samples)
        return digest.certified_percentiles(digest.clean_samples(samples, salts), list(keys), salts=salts)

    return query


def p2_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per scenario from digests of single days and shards, merged."""
    samples = digest.clean_samples(table(spark, d, "run_sample"))
    daily = digest.build_digests(samples, ["name", "day", "shard"])
    merged = digest.merge_digests(daily, ["name"], fan_in=["day", "shard"])
    return digest.percentiles(merged, ["name"]).select(
        "name", "n", "q", "value",
        (F.greatest(F.abs(100.0 * F.col("below_least") / F.col("n") - 100 * F.col("q")), F.abs(100.0 * F.col("upto_most") / F.col("n") - 100 * F.col("q")))).alias("rank_error_bound"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "artifact_record")).select("artifact_id", "line")


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "artifact_record"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "artifact_record"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag_defects(table(spark, d, "session_turn"))


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(_sized(spark, d)), table(spark, d, "context_window"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_windows(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d, "source"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(_documents(spark, d)).where("kind <> 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(_documents(spark, d))


def p8_functions(spark: SparkSession, d: str) -> DataFrame:
    return quality.labelling_functions(_documents(spark, d))


_QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_consensus": p1_consensus,
    "p1_annotators": p1_annotators,
    "p1_agreement": p1_agreement,
    "p2_found": p2_found,
    "p2_by_name": _certified("name"),
    "p2_by_series": _certified("series_id", "name"),
    "p2_by_day": _certified("name", "day"),
    "p2_by_shard": _certified("name", "shard"),
    "p2_merged_days": p2_merged_days,
    "p3_found": p3_found,
    "p3_rules": p3_rules,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p6_windows": p6_windows,
    "p6_fill": p6_fill,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_functions": p8_functions,
}


def queries() -> dict[str, Query]:
    return {n: (lambda spark, d, f=f: f(ship(spark), d)) for n, f in _QUERIES.items()}


_P1_VOTES = r"""
book AS (SELECT * FROM (VALUES ('response','correct'),('response','silent_wrong'),('response','explicit_uncertain'),('response','incomplete'),
  ('response','other_wrong'),('response','indeterminate'),('summary','retained'),('summary','omitted'),('summary','contradicted'),('summary','unassessable')) t(kind, label)),
item AS (SELECT item_id, any_value(kind) AS kind, any_value(claude_label) AS claude, any_value(openai_label) AS openai, any_value(final_label) AS final, any_value(adjudicated) AS adjudicated
  FROM (SELECT DISTINCT * FROM verify) GROUP BY item_id),
plain AS (SELECT item_id, kind, adjudicated,
  CASE WHEN (kind, norm(claude)) IN (SELECT (kind, label) FROM book) THEN norm(claude) END AS c,
  CASE WHEN (kind, norm(openai)) IN (SELECT (kind, label) FROM book) THEN norm(openai) END AS o,
  CASE WHEN (kind, norm(final)) IN (SELECT (kind, label) FROM book) THEN norm(final) END AS f FROM item),
agreed AS (SELECT *, coalesce(adjudicated, 0) <> 1 AND f IS NOT NULL AND coalesce(c, f) = f AND coalesce(o, f) = f AS same FROM plain),
first AS (SELECT item_id, kind, 'claude' AS annotator, CASE WHEN same THEN f ELSE c END AS label FROM agreed
  UNION ALL SELECT item_id, kind, 'openai', CASE WHEN same THEN f ELSE o END FROM agreed
  UNION ALL SELECT item_id, kind, 'adjudicator', CASE WHEN NOT coalesce(same, false) THEN f END FROM agreed),
rated AS (SELECT item_id, kind, rater_id AS annotator, label FROM (
  SELECT r.item_id, p.kind, r.rater_id, norm(r.label) AS label, row_number() OVER (PARTITION BY r.item_id, r.rater_id ORDER BY rated_at DESC, rating_id DESC) AS k
  FROM (SELECT DISTINCT rating_id, item_id, rater_id, label, rated_at FROM rating) r JOIN plain p USING (item_id)
  WHERE (p.kind, norm(r.label)) IN (SELECT (kind, label) FROM book)) WHERE k = 1),
votes AS (SELECT * FROM first WHERE label IS NOT NULL UNION ALL SELECT * FROM rated)"""


def _norm(m: re.Match[str]) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({m[1]})), '[.\s]+$', ''), '[\s_-]+', '_', 'g')"


def _p1_sql(tail: str) -> str:
    return "WITH" + re.sub(r"norm\(([\w.]+)\)", _norm, _P1_VOTES) + tail


_SAMPLES = """s AS (SELECT series_id, lower(trim(name)) AS name, v FROM (
  SELECT series_id, name, latency_ms AS v, row_number() OVER (PARTITION BY sample_id ORDER BY received_at, latency_ms) AS k FROM run_sample
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0) WHERE k = 1)"""

_SQL = {
    "p1_agreement": _p1_sql("""
, per AS (SELECT item_id, kind, label, count(*) AS n FROM votes GROUP BY ALL),
units AS (SELECT item_id, kind, sum(n) AS m, sum(n * (n - 1.0)) AS same FROM per GROUP BY ALL HAVING sum(n) > 1),
t AS (SELECT kind, count(*) AS n_units, sum(m) AS n_values, sum((m * (m - 1.0) - same) / (m - 1.0)) AS apart FROM units GROUP BY kind),
q AS (SELECT kind, sum(n * (n - 1.0)) AS alike FROM (SELECT p.kind, p.label, sum(p.n) AS n FROM per p JOIN units u USING (item_id) GROUP BY ALL) GROUP BY kind)
SELECT kind, n_units, n_values::BIGINT AS n_values, round((apart / n_values)::DOUBLE, 6) AS observed, round((1 - alike / (n_values * (n_values - 1.0)))::DOUBLE, 6) AS expected,
  round((1 - (apart / n_values) / (1 - alike / (n_values * (n_values - 1.0))))::DOUBLE, 6) AS alpha FROM t JOIN q USING (kind)"""),
    "p2_found": f"""WITH {_SAMPLES},
r AS (SELECT DISTINCT report_id, series_id, lower(trim(name)) AS name, median_latency_ms AS m, p95_latency_ms AS p FROM run_report),
c AS (SELECT report_id, m, p, count(*) AS n, sum((v < m)::INT) AS mb, sum((v <= m)::INT) AS mu, sum((v < p)::INT) AS pb, sum((v <= p)::INT) AS pu FROM r JOIN s USING (series_id, name) GROUP BY ALL)
SELECT DISTINCT report_id FROM c WHERE (m IS NOT NULL AND greatest(100.0 * mb / n - 50, 50 - 100.0 * mu / n) > 2) OR (p IS NOT NULL AND greatest(100.0 * pb / n - 95, 95 - 100.0 * pu / n) > 2)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
