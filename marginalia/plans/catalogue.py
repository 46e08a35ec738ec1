"""The core queries: every operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import sessions
from marginalia.evals import dataset, ledger, schedule
from marginalia.functions.text import WS_JAVA, estimate_tokens, fits_budget, language_code, plain_label
from marginalia.operators import images, intervals, nested, policy, retrieve, store, summarize, textindex
from marginalia.runtime import ship, spread, table
from marginalia.stats import robust
from marginalia.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUESTION = "packing list retrieval log"
BUDGET = 120
ARMS = ["fixed_chunk", "full_source", "gold_reference", "optimized"]
ALGORITHM, SEED = "sha256-rank-v1", "0" * 64
ROUNDS, BOOT_SEED = 10_000, 7
CONDITIONS = ["S0", "S1", "S2", "S3", "S4", "S9"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "family_id", "path"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_turns(table(spark, d, "session_turn"))


# ---------------------------------------------------------------- text


def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


def budget_fit(spark, d):
    est = estimate_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", est.alias("tokens"), fits_budget(est, F.lit(400)).alias("fits"))


def token_by_lang(spark, d):
    """By language; its spellings count as one, and a missing or unknown one as ``other``."""
    return docs(spark, d).groupBy(language_code(F.col("lang")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))


def line_index(spark, d):
    return textindex.lines(docs(spark, d), "doc_id", "text")


def line_map_agreement(spark, d):
    """Lines derived from the artifacts against the recorded ones: counts of equal, extra and missing."""
    a = table(spark, d, "artifact_record").select("artifact_id", "content").distinct()
    own = textindex.lines(a, "artifact_id", "content").select("artifact_id", "line", "start_byte", "end_byte", "text", "delimiter")
    told = table(spark, d, "source_line").select(own.columns).distinct()
    tagged = own.withColumn("o", F.lit(1)).withColumn("t", F.lit(0)).unionByName(told.withColumn("o", F.lit(0)).withColumn("t", F.lit(1)))
    both = tagged.groupBy(own.columns).agg(F.max("o").alias("o"), F.max("t").alias("t"))
    return both.agg(F.count(F.when((F.col("o") == 1) & (F.col("t") == 1), 1)).alias("equal"), F.count(F.when(F.col("t") == 0, 1)).alias("extra"), F.count(F.when(F.col("o") == 0, 1)).alias("missing"))


def artifact_ids(spark, d):
    return textindex.artifacts(docs(spark, d), "doc_id", "path", "text")


def line_stats(spark, d):
    t = textindex.split_lines(docs(spark, d), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(~F.col("text").rlike(f"[^{WS_JAVA}]"), 1)).alias("blank_lines"), F.max(F.length("text")).alias("longest"))


def duplicate_content(spark, d):
    h = docs(spark, d).select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("sha256"))
    return h.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def split_leakage(spark, d):
    r = docs(spark, d).select("doc_id", "family_id", (F.col("doc_id") % 5).alias("split"))
    return dataset.first_seen_conflicts(r, "family_id", "split", "doc_id").select("doc_id", "family_id", "split")


def nfkc_terms(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all(dataset.nfkc_lower(F.col("text")), F.lit(r"[\p{L}\p{N}_./:-][\p{L}\p{M}\p{N}_./:-]*"), F.lit(0))).alias("terms"))


# ---------------------------------------------------------------- retrieval and summaries


def _scores(spark, d):
    return retrieve.line_scores(docs(spark, d), "doc_id", "text", QUESTION)


def term_score_lines(spark, d):
    return _scores(spark, d).where("score > 0").select("doc_id", "line", "score")


def best_line_ties(spark, d):
    return retrieve.best_lines(_scores(spark, d), "doc_id").select("doc_id", "line", "score")


def omitted_matches(spark, d):
    """Ties that the first excerpt window leaves out: exact count and the first twenty lines."""
    b = retrieve.best_lines(_scores(spark, d), "doc_id")
    near = b.withColumn("first", F.min("line").over(Window.partitionBy("doc_id"))).where("line > first + 2")
    return near.groupBy("doc_id").agg(F.count("*").alias("omitted"), F.array_join(F.slice(F.array_sort(F.collect_list("line")), 1, 20), ",").alias("lines"))


def first_excerpt(spark, d):
    r = retrieve.query_texts(docs(spark, d), "doc_id", "text", QUESTION, BUDGET, 2, 1)
    return retrieve.excerpts_of(r, "doc_id").select("doc_id", "start_line", "end_line", "start_byte", "end_byte", "tokens")


def multi_excerpt(spark, d):
    return retrieve.excerpts_of(retrieve.query_texts(docs(spark, d), "doc_id", "text", QUESTION, BUDGET), "doc_id")


def query_responses(spark, d):
    r = retrieve.query_texts(docs(spark, d), "doc_id", "text", QUESTION, BUDGET)
    return r.select("doc_id", "estimated_tokens", "fallback_reason", "warning", "more_count", F.array_join("more_lines", ",").alias("more_lines"), F.size("excerpts").alias("excerpts"))


def _spans(spark, d):
    b = retrieve.best_lines(_scores(spark, d), "doc_id")
    return b.select("doc_id", F.greatest(F.lit(1), F.col("line") - 2).alias("start_line"), (F.col("line") + 2).alias("end_line"))


def merge_spans(spark, d):
    return intervals.merge_spans(_spans(spark, d), "doc_id")


def gold_containment(spark, d):
    """Lines that name the gold phrase and lie in a span around the question's best lines."""
    gold = textindex.split_lines(docs(spark, d), "doc_id", "text").where("contains(lower(text), 'packing list')").select("doc_id", "line")
    return intervals.contained(gold, intervals.merge_spans(_spans(spark, d), "doc_id"), "doc_id", "line").select("doc_id", "line", "start_line", "end_line")


def span_overlaps(spark, d):
    a = intervals.merge_spans(_spans(spark, d), "doc_id").select("doc_id", F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    long = textindex.split_lines(docs(spark, d), "doc_id", "text").where("length(text) > 200").select("doc_id", F.col("line").alias("r_start"), (F.col("line") + 1).alias("r_end"))
    return intervals.overlapping(a, long, "doc_id").select("doc_id", "l_start", "l_end", "r_start", "r_end")


def query_variants(spark, d):
    q = turns(spark, d).select("question").distinct()
    stop = "the a an of to in on at is are was were be what which how why please with and or".split()
    return q.select("question", retrieve.keyword_variant(F.col("question"), stop).alias("keywords"), retrieve.entity_variant(F.col("question")).alias("entity"))


def summary_prefix(spark, d):
    return summarize.prefix_summaries(docs(spark, d), "doc_id", "text", BUDGET).select("doc_id", "n_lines", "kept_lines", "tokens", "truncated", "fallback_reason", F.length("summary").alias("summary_chars"))


def gated_summary(spark, d):
    t = docs(spark, d)
    return summarize.gated_summaries(t, "doc_id", "text", BUDGET)


# ---------------------------------------------------------------- policy


def policy_reasons(spark, d):
    b = docs(spark, d).select("doc_id", policy.rule_bits(F.col("text")).alias("b"))
    flags = []
    for reason in dict.fromkeys(r for r, _ in policy.RULES):
        bits = sum(1 << i for i, (r, _) in enumerate(policy.RULES) if r == reason)
        flags.append((F.col("b").bitwiseAND(F.lit(bits)) != 0).alias(reason))
    return b.select("doc_id", *flags, (F.col("b").bitwiseAND(F.lit(policy.VISUAL_BIT)) != 0).alias("visual"))


def policy_mode(spark, d):
    c = policy.classify(docs(spark, d), "doc_id", "text")
    return c.select("doc_id", "mode", F.array_join("reasons", ",").alias("reasons"), "lossy_allowed")


def policy_artifacts(spark, d):
    a = table(spark, d, "artifact_record").groupBy("artifact_id").agg(F.max_by("content", F.struct("indexed_at", F.xxhash64("content"))).alias("content"))
    return policy.classify(a, "artifact_id", "content").groupBy("mode").agg(F.count("*").alias("artifacts"))


# ---------------------------------------------------------------- evaluation


def content_match(spark, d):
    t = turns(spark, d)
    return t.select("attempt_id", "turn", sessions.matches_gold(F.col("answer"), F.col("gold")).alias("correct"), sessions.unreadable(F.col("answer")).alias("unreadable"))


def _runs(spark, d):
    t = turns(spark, d).where("condition_code is not null")
    graded = F.coalesce(F.size("gold") > 0, F.lit(False))
    outcome = F.when(F.col("answer").isNull(), "failure").when(~graded, "ungraded").when(sessions.matches_gold(F.col("answer"), F.col("gold")), "success").otherwise("failure")
    return t.select(
        F.col("condition_code").alias("arm"), F.col("template").alias("family"), "attempt_id", "turn", outcome.alias("outcome"),
        (F.coalesce("tool_calls", F.lit(0)) * 0.25 + F.coalesce("originals_requested", F.lit(0)) * 0.5).cast("double").alias("cost"),
        ((F.unix_micros("received_at") - F.unix_micros("answered_at")) / 1000.0).alias("latency"),
    )


def outcome_class(spark, d):
    return _runs(spark, d).groupBy("arm", "outcome").agg(F.count("*").alias("runs"))


def _ledger(spark, d):
    """``_runs`` as a ledger of planned runs: a family's turns by parity (two languages) and pair (three attempts).

    A planned run succeeds when at least half of its graded turns do, and is ungraded when no turn is graded.
    """
    r = _runs(spark, d).where("turn between 1 and 9")
    half = F.when(F.col("turn") % 2 == 0, "ko").otherwise("en")
    won, graded = (F.count(F.when(c, 1)) for c in (F.col("outcome") == "success", F.col("outcome") != "ungraded"))
    outcome = F.when(graded == 0, "ungraded").when(won * 2 >= graded, "success").otherwise("failure")
    return r.groupBy("arm", "family", half.alias("language"), (F.floor((F.col("turn") - 1) / 2) % 3 + 1).alias("attempt")).agg(outcome.alias("outcome"), F.sum("cost").alias("cost"), F.max("latency").alias("latency"))


def _plan(spark, d):
    f = _runs(spark, d).select("family").distinct()
    return f.withColumn("language", F.explode(F.array(F.lit("en"), F.lit("ko")))).select("family", F.concat_ws("-", "family", "language").alias("task"), "language", F.lit("factual").alias("category"))


def arm_report(spark, d):
    """Reports of the planned runs of all arms; some arms are complete, some lack runs and one has none."""
    plan = _plan(spark, d)
    r = ledger.arm_report(_ledger(spark, d), spark.createDataFrame([(a,) for a in CONDITIONS], "arm string"), plan.count() * 3)
    return r.select(*[c for c in r.columns if c not in ("success_rate", "cost_per_success")], F.round("success_rate", 9).alias("success_rate"), F.round("cost_per_success", 9).alias("cost_per_success"))


def paired_coverage(spark, d):
    return ledger.coverage(_ledger(spark, d), CONDITIONS, _plan(spark, d).count() * 3)


def _paired(spark, d, arms=("S1", "S2")):
    return ledger.paired_success(_ledger(spark, d).where(F.col("arm").isin(*arms)), _plan(spark, d), list(arms), "S1", "S2")


def paired_diff(spark, d):
    f = _paired(spark, d)
    return f.select("family", "category", "reference_successes", "comparison_successes", *[F.round(c, 9).alias(c) for c in ("reference_rate", "comparison_rate", "difference")])


def paired_incomplete(spark, d):
    """The same over a plan with an arm that never ran: nothing is known, so there are no rows."""
    return _paired(spark, d, ("S1", "S2", "S9")).select("family", "difference")


def point_estimate(spark, d):
    return ledger.point_estimate(_paired(spark, d)).select("families", F.round("point_estimate", 9).alias("point_estimate"))


def bootstrap_ci(spark, d):
    diffs = _paired(spark, d).agg(F.sort_array(F.collect_list(F.struct("family", "difference"))).alias("x")).select(F.posexplode("x").alias("j", "x"))  # at most ledger.MAX_RUNS / 6 families
    ci = robust.interval(robust.bootstrap_means(diffs.select(F.col("j").cast("long").alias("j"), F.col("x.difference").alias("d")), ROUNDS, BOOT_SEED), ROUNDS)
    return ci.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def grouping_sets(spark, d):
    r = _runs(spark, d)
    sets = [[F.col("arm"), F.col("family")], [F.col("arm")], [F.col("family")], []]
    return r.groupingSets(sets, "arm", "family").agg(F.count("*").alias("runs"), F.round(F.avg(F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)), 9).alias("accuracy"))


def turn_groups(spark, d):
    t = turns(spark, d)
    return t.groupBy(sessions.turn_group(F.col("turn_type")).alias("turn_group"), "condition_code").agg(F.count("*").alias("turns"), F.count(F.when(F.col("threshold_exceeded"), 1)).alias("exceeded"), F.sum("tool_calls").alias("tool_calls"), F.sum("originals_requested").alias("originals"))


def two_level_mean(spark, d):
    per = _runs(spark, d).groupBy("arm", "family").agg(F.avg(F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)).alias("score"))
    return per.groupBy("arm").agg(F.round(F.avg("score"), 9).alias("mean_score"))


def dataset_issues(spark, d):
    r = docs(spark, d).select(
        F.col("doc_id").alias("idx"), (F.col("doc_id") - F.when(F.col("doc_id") % 997 == 0, 1).otherwise(0)).alias("id"), "family_id", (F.col("doc_id") % 5).alias("split"),
        F.when(F.col("doc_id") % 11 == 0, "exact").otherwise("factual").alias("category"), F.when(F.col("doc_id") % 22 == 0, "exact").otherwise("semantic").alias("rubric_kind"),
        F.coalesce("text", F.lit("")).alias("source_text"), F.sha2(F.encode(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 101 == 0, "x").otherwise("")), "utf-8"), 256).alias("source_sha256"),
    )
    return dataset.dataset_issues(r)


def pilot_quota(spark, d):
    f = docs(spark, d).where("family_id is not null").groupBy("family_id").agg(F.min_by(language_code(F.col("lang")), "doc_id").alias("category"), (F.min("doc_id") % 3).alias("split"))
    actual = f.groupBy("category", "split").agg(F.count("*").alias("actual"))
    cells = [(c, s, 20) for c in ("en", "ko", "de", "fr", "other") for s in range(3)]
    return dataset.quota_issues(actual, spark.createDataFrame(cells, "category string, split long, expected long"), ["category", "split"])


def model_inputs(spark, d):
    r = turns(spark, d).select(F.concat_ws("-", "attempt_id", "turn").alias("id"), F.lit("en").alias("language"), "answer", F.col("template").alias("source_text"), "question", F.when(F.col("turn") % 2 == 0, "test").otherwise("train").alias("split"))
    return dataset.model_inputs(r, "test")


def _tasks(spark, d):
    return turns(spark, d).select(F.col("template").alias("family")).distinct().withColumn("language", F.explode(F.array(F.lit("en"), F.lit("ko")))).withColumn("task", F.concat_ws("-", "family", "language"))


def seeded_schedule(spark, d):
    return schedule.schedule(_tasks(spark, d).select("family", "task", "language"), ARMS, 3, ALGORITHM, SEED)


def mock_run(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = o.withColumn("ordinal", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    price = F.col("o_totalprice").cast("double")
    runs = ranked.select(
        "o_custkey", "ordinal", F.lit("completed").alias("status"), (F.col("o_orderkey") % 50 + 1).cast("long").alias("duration"),
        F.floor(price / 1000).cast("long").alias("reserved"), F.when(F.col("o_orderkey") % 37 != 0, F.floor(price / 990)).cast("long").alias("settled"),
    )
    return schedule.simulate(runs, ["o_custkey"], 45, 150, 900)


def exact_check(spark, d):
    """Answers as envelopes against a registry made of the golds of one template."""
    t = turns(spark, d).where("size(gold) > 0 and answer is not null").withColumn("task_id", F.concat_ws("-", "attempt_id", "turn"))
    gold = F.get("gold", F.lit(0))
    tasks = t.select("task_id", F.when(F.col("turn") % 4 == 0, "factual").otherwise("exact").alias("category"), F.lit("exact").alias("rubric_kind"), F.lit("check-1").alias("check_id"), F.sha2(F.encode("task_id", "utf-8"), 256).alias("record_sha256"), F.sha2(F.encode(gold, "utf-8"), 256).alias("source_sha256"), gold.alias("source_text"))
    registry = t.select(F.lit("check-1").alias("check_id"), "task_id", F.when(F.col("turn") == 7, "drifted").otherwise(F.sha2(F.encode("task_id", "utf-8"), 256)).alias("record_sha256"), F.sha2(F.encode(gold, "utf-8"), 256).alias("source_sha256"), F.lit(0).alias("source_line"), gold.alias("excerpt"))
    envelopes = t.select("task_id", F.col("answer").alias("response_text"), F.when(F.col("turn") == 5, "other").otherwise("data").alias("dataset_sha256"))
    return ledger.exact_checks(envelopes, tasks, registry, "data").select("task_id", "code", "passed")


# ---------------------------------------------------------------- statistics


def _latency(spark, d):
    return table(spark, d, "run_sample").where("latency_ms >= 0 and not isnan(latency_ms)").select(F.lower(F.trim("name")).alias("name"), "sample_id", "series_id", "latency_ms", "raw_tokens", "optimized_tokens", "passed_exact_gate")


def _ranked(spark, d):
    return robust.ranked(_latency(spark, d).select("name", "latency_ms", "sample_id"), ["name"], ["latency_ms", "sample_id"])


def latency_nearest_rank(spark, d):
    return robust.order_statistics(_ranked(spark, d), ["name"], "latency_ms", {"p50": 0.5, "p95": 0.95})


def type7_quantiles(spark, d):
    q = robust.order_statistics(_ranked(spark, d), ["name"], "latency_ms", cont={"q25": 0.025, "q500": 0.5, "q975": 0.975})
    return q.select("name", *[F.round(c, 6).alias(c) for c in ("q25", "q500", "q975")])


def sample_cv(spark, d):
    return _latency(spark, d).groupBy("name").agg(F.round(robust.sample_cv(F.col("latency_ms")), 6).alias("cv"))


def drift_halves(spark, d):
    us = _latency(spark, d).select("name", "sample_id", F.floor(F.col("latency_ms") * 1000).alias("us"))  # whole, so that sums are exact
    return robust.drift(us, ["name"], ["sample_id", "us"], "us").select("name", *[F.round(c, 6).alias(c) for c in ("early", "late", "ratio")])


def ordered_cost_sum(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("p"))
    return li.groupBy("l_orderkey").agg(ledger.ordered_sum(F.col("p")).alias("total"))


def token_reduction(spark, d):
    s = _latency(spark, d).groupBy("name").agg(F.sum("raw_tokens").alias("raw"), F.sum("optimized_tokens").alias("optimized"))
    pct = F.when(F.col("raw") == 0, F.lit(0.0)).otherwise(F.floor((1 - F.col("optimized") / F.col("raw")) * 1000 + 0.5) / 10)
    return s.select("name", "raw", "optimized", pct.alias("reduction_pct"))


def conservative_gates(spark, d):
    """The least reduction, every gate, the largest p95 and the distinct warnings of a scenario's series."""
    s = _latency(spark, d)
    series = s.groupBy("name", "series_id").agg(F.sum("raw_tokens").alias("raw"), F.sum("optimized_tokens").alias("optimized"), F.bool_and("passed_exact_gate").alias("passed"))
    reduction = F.when(F.col("raw") == 0, F.lit(0.0)).otherwise(F.floor((1 - F.col("optimized") / F.col("raw")) * 1000 + 0.5) / 10)
    warning = F.when(F.col("passed").isNull(), "no_gate").when(~F.col("passed"), "gate_failed").when(reduction < 25, "small_reduction")
    g = series.groupBy("name").agg(
        F.count("*").alias("series"), F.min(reduction).alias("min_reduction"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"), F.bool_or("passed").alias("any_passed"),
        F.array_join(F.sort_array(F.collect_set(warning)), ",").alias("warnings"),
    )
    p = latency_nearest_rank(spark, d).select("name", "p95")
    return g.join(p, "name").withColumn("fails", (F.col("p95") > 1000) | ~F.col("all_passed") | (F.col("min_reduction") < 25))


def verdicts(spark, d):
    """Timing of a change against two runs of the base: 36 rounds in 6 blocks for each scenario.

    A scenario's samples are dealt to the three variants and the rounds by id; a round's time is their mean.
    """
    s = _latency(spark, d).select("name", (F.col("sample_id") % 3).alias("v"), (F.floor(F.col("sample_id") / 3) % 36).cast("int").alias("r"), F.floor(F.col("latency_ms") * 1000).cast("long").alias("us"))
    mean = lambda v: F.try_divide(F.sum(F.when(F.col("v") == v, F.col("us"))).cast("double"), F.count(F.when(F.col("v") == v, 1)))
    cell = s.groupBy("name", "r").agg(mean(0).alias("a"), mean(1).alias("a2"), mean(2).alias("b"))
    good = cell.where("a > 0 and a2 > 0 and b > 0")
    per = good.groupBy("name").agg(F.count("*").alias("rounds"), F.sort_array(F.collect_list(F.struct("r", (F.col("b") / ((F.col("a") + F.col("a2")) / 2)).alias("x"), (F.col("a2") / F.col("a")).alias("y")))).alias("z"))
    whole = per.where("rounds = 36")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform(F.slice("z", i * 6 + 1, 6), lambda z: z["x"]))
    ci = robust.block_bootstrap(whole.select("name", blocks.alias("blocks")), "name", "blocks", ROUNDS, BOOT_SEED)
    aa = per.select("name", "rounds", robust.median(F.transform("z", lambda z: z["y"])).alias("aa"))
    every = s.select("name").distinct().join(aa, "name", "left").join(ci, "name", "left")
    # the tables' samples are heavy-tailed, so the bands are wider than a timing run's
    verdict = robust.gate_verdict(F.col("aa"), F.col("point"), F.col("hi"), F.coalesce(F.col("rounds") == 36, F.lit(False)), noise=0.25, gate=1.1)
    return every.select("name", F.coalesce("rounds", F.lit(0)).alias("rounds"), *[F.round(c, 9).alias(c) for c in ("aa", "point", "lo", "hi")], verdict.alias("verdict"))


def _labels(spark, d):
    v = table(spark, d, "verify").distinct()
    return v.select("item_id", "kind", *[plain_label(F.col(c)).alias(c) for c in ("claude_label", "openai_label", "final_label")])


def percent_agreement(spark, d):
    v = _labels(spark, d).where("claude_label is not null and openai_label is not null")
    return v.groupBy("kind").agg(F.count("*").alias("items"), F.round(F.avg((F.col("claude_label") == F.col("openai_label")).cast("double")), 9).alias("agreement"))


def label_crosstab(spark, d):
    return _labels(spark, d).groupBy("claude_label", "openai_label").agg(F.count("*").alias("items"))


def paired_raters(spark, d):
    """The adjudicated label where two first labels differ, else the common one."""
    label = F.when(F.col("claude_label") == F.col("openai_label"), F.col("claude_label")).otherwise(F.col("final_label"))
    return _labels(spark, d).select("item_id", "claude_label", "openai_label", label.alias("settled")).where("claude_label is not null and openai_label is not null")


def audit_order(spark, d):
    v = table(spark, d, "verify").select("item_id").distinct()
    return v.select("item_id", F.sha2(F.concat(F.lit("order-v1|rater-01|"), F.col("item_id").cast("string")), 256).alias("rank_key"))


# ---------------------------------------------------------------- sessions


def compaction_epochs(spark, d):
    t = turns(spark, d).select("attempt_id", "turn", (estimate_tokens(F.coalesce("question", F.lit(""))) + estimate_tokens(F.coalesce("answer", F.lit("")))).alias("tokens"))
    return sessions.compaction_epochs(t).select("attempt_id", "turn", "epoch", "running_tokens")


def cache_cost(spark, d):
    t = turns(spark, d).where("condition_code is not null").groupBy("condition_code", "attempt_id").agg(
        F.sum(estimate_tokens(F.coalesce("question", F.lit("")))).alias("prompt"), F.sum(estimate_tokens(F.coalesce("answer", F.lit("")))).alias("completion"), F.sum("tool_calls").alias("calls"))
    u = t.select("condition_code", "prompt", "completion", (F.col("prompt") * 0.5).alias("cached"), (F.col("prompt") * 0.25).alias("cache_write"))
    return sessions.cost_views(u, ["condition_code"], 2.5, 10.0, 0.5, 1.25).select("condition_code", F.round("list_cost", 9).alias("list_cost"), F.round("cache_cost", 9).alias("cache_cost"))


def missing_slots(spark, d):
    t = turns(spark, d)
    slots = t.select("attempt_id").distinct().withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return sessions.missing_slots(slots, t, ["attempt_id", "turn"])


def latest_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when((F.col("event_id") % 3 != 0) & (F.col("event_type") != "error"), "ok").otherwise("failed").alias("status"), "event_type")
    return sessions.latest_wins(e, "user_id", "event_id").select("user_id", "event_id", "status")


def optional_key_join(spark, d):
    """Turns of a session and condition with the attempt's record, where the record names its attempt or none."""
    r = table(spark, d, "session_record").groupBy("session_id", "condition_code").agg(F.count("*").alias("deliveries"), F.min(F.when(F.col("record_id") % 2 == 0, F.col("attempt_id"))).alias("only"))
    t = turns(spark, d).select("session_id", "condition_code", "attempt_id", "turn")
    j = t.join(r, ["session_id", "condition_code"]).where("only is null or only = attempt_id")
    return j.groupBy("condition_code").agg(F.count("*").alias("turns"), F.countDistinct("attempt_id").alias("attempts"))


def lru_replay(spark, d):
    a = table(spark, d, "artifact_record").select("artifact_id", "byte_length", "line_count", "indexed_at")
    log = a.select(F.pmod(F.xxhash64("artifact_id"), F.lit(50)).alias("session"), F.unix_micros("indexed_at").alias("seq"), F.lit("put").alias("op"), "artifact_id", store.weight(F.col("byte_length"), F.col("line_count")).alias("weight"))
    return store.replay(log, 2_000_000)


def stream_index(spark, d):
    return ingest.index_stream(docs(spark, d)).select("doc_id", "artifact_id", "line_count", "tokens")


def graded_slots(spark, d):
    t = turns(spark, d).where("condition_code is not null")
    return t.groupBy("condition_code").agg(F.count("*").alias("slots"), F.count(F.when(sessions.strict_match(F.col("answer"), F.col("gold")), 1)).alias("strict"), F.count(F.when(sessions.content_match(F.col("answer"), F.col("gold")), 1)).alias("content"))


def question_keywords(spark, d):
    q = turns(spark, d).select("question").distinct()
    return q.select("question", F.array_join(F.array_sort(sessions.keywords(F.col("question"), ["the", "what", "which", "please", "with"])), " ").alias("keywords"))


def slot_costs(spark, d):
    t = turns(spark, d).select("attempt_id", "turn", estimate_tokens(F.coalesce("question", F.lit(""))).alias("p"))
    return t.select("attempt_id", "turn", F.round(sessions.slot_cost(F.col("p"), 60, 3, 2.5, 10.0), 9).alias("cost"))


def paired_conditions(spark, d):
    """Self join of two conditions' family scores, families with both only."""
    per = _runs(spark, d).groupBy("arm", "family").agg(F.avg(F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)).alias("score"))
    a, b = (per.where(F.col("arm") == x).select("family", F.col("score").alias(n)) for x, n in (("S2", "a"), ("S0", "b")))
    return a.join(b, "family").select("family", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), F.round(F.col("a") - F.col("b"), 9).alias("diff"))


def _graded(spark, d):
    t = turns(spark, d).where("condition_code is not null")
    return t.select(
        F.col("condition_code").alias("arm"), F.concat_ws("/", "attempt_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("key"), F.col("template").alias("family"), "question", sessions.turn_group(F.col("turn_type")).alias("condition"),
        (F.coalesce("tool_calls", F.lit(0)) > 0).alias("matched"), F.when(F.col("answer").isNull(), "failed").otherwise("answered").alias("outcome"), "answer", sessions.matches_gold(F.col("answer"), F.col("gold")).alias("correct"),
        estimate_tokens(F.concat_ws(" ", "question", "answer")).cast("long").alias("tokens"), (F.coalesce("originals_requested", F.lit(0)) * 0.5 + 0.25).alias("cost"),
    )


def derived_arms(spark, d):
    """Two derived arms of S2 with S0 as the original: read again where unreadable, and only where a window matched."""
    g = _graded(spark, d)
    rows = g.withColumn("fallback", F.lit(None).cast("string")).drop("matched")
    for name, by_match in (("S2R", False), ("S2p", True)):
        rows = rows.unionByName(ledger.fallback_arm(g, "S2", "S0", name, by_match))
    return rows.groupBy("arm", "outcome", "fallback").agg(F.count("*").alias("runs"), F.count(F.when(F.col("correct"), 1)).alias("correct"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def started_means(spark, d):
    """Accuracy by derived arm and condition, runs that never started left out."""
    g = _graded(spark, d)
    rows = ledger.fallback_arm(g, "S2", "S0", "S2p", True)
    return rows.groupBy("condition").agg(F.count("*").alias("runs"), F.count(F.when(F.col("outcome") == "not_started", 1)).alias("not_started"), F.round(ledger.started_mean(F.col("outcome"), F.col("correct")), 9).alias("accuracy"))


def excerpt_replay(spark, d):
    """Per text with lines that name the gold phrase: whether the first or any excerpt holds one, and whether a tie took its place."""
    e = multi_excerpt(spark, d).select("doc_id", "excerpt_no", "start_line", "end_line")
    spans = e.groupBy("doc_id").agg(F.collect_list(F.struct("excerpt_no", "start_line", "end_line")).alias("spans"))  # at most 20 a text
    s = _scores(spark, d)
    gold = s.where("contains(lower(text), 'packing list')").select("doc_id", "line", "score")
    best = s.groupBy("doc_id").agg(F.max("score").alias("best"))
    near = lambda x: F.col("line").between(x["start_line"], x["end_line"])
    j = gold.join(spans, "doc_id", "left").join(best, "doc_id").select("doc_id", F.exists("spans", lambda x: near(x) & (x["excerpt_no"] == 1)).alias("h1"), F.exists("spans", near).alias("h"), (F.col("score") == F.col("best")).alias("tied"))
    per = j.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("h1", "h", "tied")])
    return per.agg(F.count("*").alias("texts"), F.count(F.when(F.col("h1"), 1)).alias("hits"), F.count(F.when(F.col("h"), 1)).alias("hits_any"), F.count(F.when(~F.col("h") & F.col("tied"), 1)).alias("lost_to_tie"))


# ---------------------------------------------------------------- images


def _grid(spark):
    sizes = [64, 256, 512, 768, 1000, 1092, 1536, 2049, 4096]
    return spark.createDataFrame([(w, h) for w in sizes for h in sizes], "w long, h long")


def image_tokens(spark, d):
    return _grid(spark).select("w", "h", images.tile_tokens(F.col("w"), F.col("h")).alias("tiles"), images.patch_tokens(F.col("w"), F.col("h")).alias("patches"))


def overview_sizes(spark, d):
    o = images.overview_size(F.col("w"), F.col("h"))
    return _grid(spark).select("w", "h", o["width"].alias("ow"), o["height"].alias("oh"))


def _recorded_sizes(spark, d):
    """Distinct sizes of requested originals and image results."""
    n = nested.flatten(table(spark, d, "session_record"), every=True).where("kind in ('original', 'image') and width > 0 and height > 0")
    return n.select(F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h")).distinct()


def image_tokens_recorded(spark, d):
    """As image_tokens, whose SQL fixes its grid, over all recorded sizes."""
    return _recorded_sizes(spark, d).select("w", "h", images.tile_tokens(F.col("w"), F.col("h")).alias("tiles"), images.patch_tokens(F.col("w"), F.col("h")).alias("patches"))


def overview_sizes_recorded(spark, d):
    o = images.overview_size(F.col("w"), F.col("h"))
    return _recorded_sizes(spark, d).select("w", "h", o["width"].alias("ow"), o["height"].alias("oh"))


def crop_decisions(spark, d):
    c = nested.originals_table(nested.flatten(table(spark, d, "session_record"))).where("width is not null and height is not null")
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    decision = images.crop_decision(F.lit(1092), F.lit(1092), F.lit(0), F.lit(0), w, h)
    return c.groupBy(decision.alias("decision")).agg(F.count("*").alias("requests"))


# ---------------------------------------------------------------- nested records


def p5_found(spark, d):
    n = nested.flatten(table(spark, d, "session_record"))
    return n.where("kind <> 'turn'").select("record_id", "turn", "kind", "parent_no", "item_no")


def p5_turns(spark, d):
    return nested.turns_table(nested.flatten(table(spark, d, "session_record")))


def p5_tool_calls(spark, d):
    return nested.calls_table(nested.flatten(table(spark, d, "session_record")))


def p5_excerpts(spark, d):
    return nested.excerpts_table(nested.flatten(table(spark, d, "session_record")))


def p5_originals(spark, d):
    return nested.originals_table(nested.flatten(table(spark, d, "session_record")))


def p5_images(spark, d):
    return nested.images_table(nested.flatten(table(spark, d, "session_record"), every=True))


def p5_more_matches(spark, d):
    return nested.more_matches_table(nested.flatten(table(spark, d, "session_record"), every=True))


def p5_errors(spark, d):
    return nested.errors_table(nested.flatten(table(spark, d, "session_record"), every=True))


_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        token_estimate, budget_fit, token_by_lang, line_index, line_map_agreement, artifact_ids, line_stats, duplicate_content, split_leakage, nfkc_terms,
        term_score_lines, best_line_ties, omitted_matches, first_excerpt, multi_excerpt, query_responses, merge_spans, gold_containment, span_overlaps, query_variants,
        summary_prefix, gated_summary, policy_reasons, policy_mode, policy_artifacts, content_match, outcome_class, arm_report, paired_coverage, paired_diff, paired_incomplete, point_estimate, bootstrap_ci,
        grouping_sets, turn_groups, two_level_mean, dataset_issues, pilot_quota, model_inputs, seeded_schedule, mock_run, exact_check, latency_nearest_rank, type7_quantiles,
        sample_cv, drift_halves, ordered_cost_sum, token_reduction, conservative_gates, verdicts, percent_agreement, label_crosstab, paired_raters, audit_order,
        compaction_epochs, cache_cost, missing_slots, latest_wins, optional_key_join, lru_replay, stream_index, graded_slots, question_keywords, slot_costs, paired_conditions, derived_arms, started_means, excerpt_replay, image_tokens, overview_sizes, image_tokens_recorded, overview_sizes_recorded, crop_decisions,
        p5_found, p5_turns, p5_tool_calls, p5_excerpts, p5_originals, p5_images, p5_more_matches, p5_errors,
    )
}


def queries() -> dict[str, Query]:
    return {n: (lambda spark, d, f=f: f(ship(spark), d)) for n, f in _QUERIES.items()}
