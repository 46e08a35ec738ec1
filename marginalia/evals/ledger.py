"""Scoring of evaluation ledgers: outcomes, arm reports, paired differences, exact checks.

All integrity checks are anti-joins or duplicate counts raised in a fixed order; all reports are
aggregates over declared arms, so an arm without runs is reported too.  Unknown is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of one plan, which bounds every array of a report.
MAX_RUNS = 100_000
# What a paired analysis needs.
ATTEMPTS, LANGUAGES = 3, ("en", "ko")


def outcome(status: Column, judged: Column, covered: Column, contradiction: Column, exact: Column) -> Column:
    """success, failure or ungraded.  No covered facts at all count as all covered."""
    good = F.forall(F.coalesce(covered, F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False))) & ~F.coalesce(contradiction, F.lit(False)) & F.coalesce(exact, F.lit(True))
    return F.when(status != "completed", "failure").when(~judged, "ungraded").when(good, "success").otherwise("failure")


def ordered_sum(values: Column) -> Column:
    """Sum of a group's values in ascending order, the same in every input order."""
    return F.aggregate(F.sort_array(F.collect_list(values)), F.lit(0.0), lambda a, x: a + x)


def arm_report(runs: DataFrame, arms: DataFrame, planned: int | Column) -> DataFrame:
    """One row per declared arm.

    ``runs``: ``arm, outcome, cost, latency``; ``arms``: ``arm``.  ``success_rate`` is over planned
    runs and null while any run is ungraded; costs are null while any is unknown or a run is missing.  A plan has
    at most ``MAX_RUNS`` runs, which bounds an arm's array of costs; a larger ledger raises.
    """
    if runs.limit(MAX_RUNS + 1).count() > MAX_RUNS:
        raise ValueError("analysis_capacity_exceeded")
    per = runs.groupBy("arm").agg(
        F.count("*").alias("submitted"),
        F.count(F.when(F.col("outcome") == "success", 1)).alias("successes"),
        F.count(F.when(F.col("outcome") == "ungraded", 1)).alias("ungraded"),
        F.count(F.when(F.col("cost").isNull(), 1)).alias("_unknown"),
        ordered_sum(F.col("cost")).alias("_cost"),
        F.count("latency").alias("latency_n"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency)").alias("median_latency"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95_latency"),
    )
    zero = ["submitted", "successes", "ungraded", "_unknown", "latency_n"]
    r = arms.join(per, "arm", "left").na.fill(0, zero).withColumn("planned", planned if isinstance(planned, Column) else F.lit(planned).cast("long"))
    missing = F.col("planned") - F.col("submitted")
    cost = F.when((F.col("_unknown") == 0) & (missing <= 0), F.coalesce("_cost", F.lit(0.0)))
    return r.select(
        "arm", "planned", "submitted", missing.alias("missing"), "ungraded", "successes",
        (F.col("submitted") - F.col("successes") - F.col("ungraded")).alias("failures"),
        ((missing == 0) & (F.col("ungraded") == 0)).alias("complete"),
        F.when(F.col("ungraded") == 0, F.col("successes") / F.col("planned")).alias("success_rate"),
        cost.alias("total_cost"),
        F.when((F.col("successes") > 0) & (F.col("ungraded") == 0), cost / F.col("successes")).alias("cost_per_success"),
        "latency_n", "median_latency", "p95_latency",
    )


def check_ledger(runs: DataFrame, tasks: DataFrame, arms: DataFrame, attempts: int) -> None:
    """Raise the first of out_of_plan, duplicate_run, judgment_shape that the ledger has."""
    stray = runs.join(tasks.select("task_id"), "task_id", "left_anti").unionByName(runs.join(arms.select("arm"), "arm", "left_anti").select(runs.columns)).unionByName(runs.where((F.col("attempt") > attempts) | (F.col("attempt") < 1)))
    if not stray.isEmpty():
        raise ValueError("out_of_plan")
    if not runs.groupBy("task_id", "arm", "attempt").count().where("count > 1").isEmpty():
        raise ValueError("duplicate_run")
    j = runs.where("judgment is not null").join(tasks.select("task_id", F.size("required_facts").alias("_facts"), (F.col("category") == "exact").alias("_exact")), "task_id")
    odd = (F.col("status") != "completed") | (F.size("judgment.covered_facts") != F.col("_facts")) | (F.col("_exact") != F.col("judgment.exact_check_passed").isNotNull())
    if not j.where(odd).isEmpty():
        raise ValueError("judgment_shape")


def coverage(outcomes: DataFrame, arms: list[str], planned: int) -> DataFrame:
    """``arm, planned, submitted, missing, ungraded`` for every arm of the plan."""
    declared = outcomes.sparkSession.createDataFrame([(x,) for x in sorted(set(arms))], "arm string")
    per = outcomes.groupBy("arm").agg(F.count("*").alias("submitted"), F.count(F.when(F.col("outcome") == "ungraded", 1)).alias("ungraded"))
    c = declared.join(per, "arm", "left").na.fill(0).withColumn("planned", F.lit(planned).cast("long"))
    return c.select("arm", "planned", "submitted", (F.col("planned") - F.col("submitted")).alias("missing"), "ungraded")


def paired_success(outcomes: DataFrame, tasks: DataFrame, arms: list[str], reference: str, comparison: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``family, category, reference_successes, comparison_successes, reference_rate, comparison_rate, difference``.

    ``tasks`` (``family, task, language, category``) and ``arms`` are the plan, ``outcomes``
    (``arm, family, outcome``) one row per run.  A plan that can't be compared raises; while a planned run of any arm is
    missing or ungraded nothing is known, and there are no rows.  Rates are over the planned runs of a family.
    """
    if not {reference, comparison} <= set(arms):
        raise ValueError("missing_contrast_arm")
    if attempts != ATTEMPTS:
        raise ValueError("unsupported_analysis_attempts")
    n = tasks.count()
    if n * attempts * len(set(arms)) > MAX_RUNS:
        raise ValueError("analysis_capacity_exceeded")
    family = tasks.groupBy("family").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("language")).alias("languages"), F.countDistinct("category").alias("categories"), F.min("category").alias("category"))
    if not family.where((F.col("n") != len(LANGUAGES)) | (F.col("languages") != F.array(*map(F.lit, LANGUAGES))) | (F.col("categories") != 1)).isEmpty():
        raise ValueError("invalid_analysis_family")
    per_family = len(LANGUAGES) * attempts
    open_ = coverage(outcomes, arms, n * attempts).where("missing <> 0 or ungraded <> 0").agg(F.count("*").alias("open"))
    hit = lambda arm: F.count(F.when((F.col("arm") == arm) & (F.col("outcome") == "success"), 1))
    won = outcomes.groupBy("family").agg(hit(reference).alias("reference_successes"), hit(comparison).alias("comparison_successes"))
    whole = open_.where("open = 0").select(F.lit(True).alias("complete"))
    f = family.select("family", "category", F.lit(True).alias("complete")).join(won, "family", "left").na.fill(0, ["reference_successes", "comparison_successes"]).join(F.broadcast(whole), "complete")  # a row or none
    rate = lambda c: F.col(c) / F.lit(float(per_family))
    return f.select(
        "family", "category", "reference_successes", "comparison_successes", rate("reference_successes").alias("reference_rate"), rate("comparison_successes").alias("comparison_rate"),
        ((F.col("comparison_successes") - F.col("reference_successes")) / F.lit(float(per_family))).alias("difference"),
    )


def point_estimate(families: DataFrame) -> DataFrame:
    """Mean difference over families from whole successes, so that it is exact; null without families."""
    gap = F.sum(F.col("comparison_successes") - F.col("reference_successes"))
    return families.agg(F.count("*").alias("families"), F.try_divide(gap.cast("double"), F.lit(float(len(LANGUAGES) * ATTEMPTS)) * F.count("*")).alias("point_estimate"))


def fallback_arm(graded: DataFrame, base: str, original: str, name: str, by_match: bool = False) -> DataFrame:
    """Rows of the derived arm ``name``: ``base``'s runs, with the answer of ``original`` where they failed to read.

    ``graded``: ``arm, key, family, question, condition, matched, outcome, answer, correct, tokens, cost``.  The original's run
    is the first by key of the same family, question and condition.  Where a run answered that the source is
    unreadable, the original's answer counts and both are paid.  With ``by_match`` a run without a matched window is the
    original's run alone, and one without an original is not started.
    """
    same = ["family", "question", "condition"]
    taken = F.struct("outcome", "answer", "correct", "tokens", "cost")
    first = graded.where(F.col("arm") == original).groupBy(*same).agg(F.min_by(taken, "key").alias("a"))
    j = graded.where(F.col("arm") == base).join(first, same, "left")
    unread = (F.col("outcome") == "answered") & F.coalesce(F.lower("answer").contains("unreadable"), F.lit(False))
    known = F.col("a").isNotNull()
    lone = known & ~F.coalesce(F.col("matched"), F.lit(False)) if by_match else F.lit(False)
    again = known & unread & ~lone
    absent = ~known if by_match else F.lit(False)
    pick = lambda c: F.when(lone | again, F.col(f"a.{c}")).otherwise(F.col(c))
    paid = lambda c: F.when(lone, F.col(f"a.{c}")).when(again, F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"a.{c}"), F.lit(0))).otherwise(F.col(c))
    outcome = F.when(absent, "not_started").when((lone | again) if by_match else F.lit(False), F.col("a.outcome")).otherwise(F.col("outcome"))
    fallback = F.when(lone, "no_window").when(again, "unreadable")
    return j.select(F.lit(name).alias("arm"), "key", *same, outcome.alias("outcome"), pick("answer").alias("answer"), pick("correct").alias("correct"), paid("tokens").alias("tokens"), paid("cost").alias("cost"), fallback.alias("fallback"))


def started_mean(outcome: Column, correct: Column) -> Column:
    """Share of correct runs: failures count as wrong, runs that never started don't count."""
    return F.avg(F.when(outcome != "not_started", F.coalesce(correct, F.lit(False)).cast("double")))


def exact_checks(envelopes: DataFrame, tasks: DataFrame, registry: DataFrame, dataset_sha256: str) -> DataFrame:
    """``task_id, code, passed``: the first check that fails names the row; null code means it passed.

    ``registry`` has ``check_id, task_id, record_sha256, source_sha256, source_line, excerpt``.
    """
    t = tasks.select("task_id", "category", "rubric_kind", "check_id", "record_sha256", "source_sha256", "source_text")
    r = registry.select("check_id", "task_id", F.col("record_sha256").alias("_rec"), F.col("source_sha256").alias("_src"), "source_line", "excerpt")
    j = envelopes.join(t, "task_id", "left").join(r, ["task_id", "check_id"], "left")
    line = F.get(F.split("source_text", "\n"), F.col("source_line"))
    code = (
        F.when(F.octet_length("response_text") > 65536, "invalid_input")
        .when(F.col("dataset_sha256") != dataset_sha256, "dataset_fingerprint_mismatch")
        .when((F.coalesce(F.col("category"), F.lit("")) != "exact") | (F.coalesce(F.col("rubric_kind"), F.lit("")) != "exact") | F.col("_rec").isNull(), "unsupported_task")
        .when(F.col("record_sha256") != F.col("_rec"), "registry_drift")
        .when((F.col("source_sha256") != F.col("_src")) | line.isNull() | (line != F.col("excerpt")), "source_fidelity_failure")
        .when(F.col("response_text") != F.col("excerpt"), "response_mismatch")
    )
    settled = code.isNull() | (code == "response_mismatch")
    return j.select("task_id", code.alias("code"), F.when(settled, code.isNull()).alias("passed"), F.when(settled, F.sha2(F.encode("response_text", "utf-8"), 256)).alias("response_sha256"))
