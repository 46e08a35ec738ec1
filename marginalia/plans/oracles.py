"""SQL that DuckDB runs on the same tables, written from the operators' contracts."""

from __future__ import annotations

from marginalia.operators import policy
from marginalia.plans.catalogue import ALGORITHM, ARMS, BOOT_SEED, BUDGET, QUESTION, ROUNDS, SEED

WS = policy.WS[1:-1]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _units(c: str) -> str:
    return rf"(length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _cjk(c: str) -> str:
    return rf"length(regexp_replace({c}, '[^\x{{3040}}-\x{{30FF}}\x{{3131}}-\x{{D7A3}}]', '', 'g'))"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


def _tokens(units: str, cjk: str, words: str) -> str:
    return f"(CASE WHEN {units} = 0 THEN 0 ELSE greatest(1, {words}, ceil(({units} - {cjk}) / 4.0)::BIGINT + {cjk}) END)::INTEGER"


def _est(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN NULL ELSE {_tokens(_units(c), _cjk(c), _words(c))} END)"


def _raw(source: str, key: str, text: str) -> str:
    return rf"""raw AS (SELECT {key}, unnest(range(1, len(x) + 1))::INTEGER AS line, unnest(x) AS s FROM (
  SELECT {key}, regexp_extract_all({text}, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') AS x FROM {source}) WHERE len(x) > 0),
parts AS (SELECT {key}, line, regexp_extract(s, '(\r\n|\r|\n)$', 1) AS delimiter, regexp_replace(s, '(\r\n|\r|\n)$', '') AS text FROM raw)"""


_LINES = _raw("documents", "doc_id", "text")
_TERMS = QUESTION.split()
_SCORE = " + ".join(f"contains(lower(text), {_q(t)})::INT" for t in _TERMS)
_BEST = f"""{_LINES}, sc AS (SELECT doc_id, line, ({_SCORE})::INTEGER AS score FROM parts),
best AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM sc WHERE score > 0) WHERE score = top)"""
_SPANS = f"""{_BEST}, spans AS (SELECT doc_id, greatest(1, line - 2) AS start_line, line + 2 AS end_line FROM best),
isl AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS i FROM isl),
merged AS (SELECT doc_id, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS merged FROM num GROUP BY doc_id, i)"""

_TURNS = """turns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id, turn ORDER BY received_at DESC) AS k FROM session_turn WHERE attempt_id IS NOT NULL AND turn IS NOT NULL) WHERE k = 1)"""


def _norm(c: str) -> str:
    return rf"""regexp_replace(regexp_replace(lower(coalesce({c}, '')), '^(?:the answer is|answer:)[\s\x{{00A0}}]*', ''), '[\s\x{{00A0}},$"''`.*]', '', 'g')"""


_OPP = "CASE {n} WHEN 'yes' THEN 'no' WHEN 'no' THEN 'yes' WHEN 'on' THEN 'off' ELSE 'on' END"
_MONTH = "CASE {n} WHEN 'jan' THEN 'january' WHEN 'feb' THEN 'february' WHEN 'mar' THEN 'march' WHEN 'apr' THEN 'april' WHEN 'may' THEN 'may' WHEN 'jun' THEN 'june' WHEN 'jul' THEN 'july' WHEN 'aug' THEN 'august' WHEN 'sep' THEN 'september' WHEN 'oct' THEN 'october' WHEN 'nov' THEN 'november' ELSE 'december' END"
_MATCH = rf"""golds AS (SELECT attempt_id, turn, answer, unnest(gold) AS g FROM turns),
one AS (SELECT attempt_id, turn, g, {_norm("answer")} AS a, {_norm("g")} AS n, lower(coalesce(answer, '')) AS t FROM golds WHERE g IS NOT NULL),
hits AS (SELECT attempt_id, turn, bool_or(CASE
  WHEN n IN ('yes', 'no', 'on', 'off') THEN list_contains(regexp_extract_all(t, '[a-z]+'), n) AND NOT list_contains(regexp_extract_all(t, '[a-z]+'), {_OPP.format(n="n")})
  WHEN regexp_full_match(trim(g), '[0-9,]+') THEN list_contains(regexp_extract_all(replace(t, ',', ''), '[0-9]+(?:\.[0-9]+)?'), n)
  WHEN n IN ('jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec') THEN a = n OR a = {_MONTH.format(n="n")}
  ELSE contains(a, n) END) AS hit FROM one GROUP BY ALL)"""
_RUNS = f"""{_TURNS}, {_MATCH},
runs AS (SELECT condition_code AS arm, template AS family, attempt_id, turn,
  CASE WHEN answer IS NULL THEN 'failure' WHEN coalesce(len(gold), 0) = 0 THEN 'ungraded' WHEN coalesce(hit, false) THEN 'success' ELSE 'failure' END AS outcome,
  (coalesce(tool_calls, 0) * 0.25 + coalesce(originals_requested, 0) * 0.5)::DOUBLE AS cost, (epoch_us(received_at) - epoch_us(answered_at)) / 1000.0::DOUBLE AS latency
  FROM turns LEFT JOIN hits USING (attempt_id, turn) WHERE condition_code IS NOT NULL)"""
_LEDGER = """slots AS (SELECT arm, family, turn % 2 AS half, (turn - 1) // 2 % 3 AS attempt, count(*) FILTER (outcome = 'success') AS won, count(*) FILTER (outcome <> 'ungraded') AS graded, sum(cost) AS cost, max(latency) AS latency
  FROM runs WHERE turn BETWEEN 1 AND 9 GROUP BY ALL),
led AS (SELECT arm, family, cost, latency, CASE WHEN graded = 0 THEN 'ungraded' WHEN won * 2 >= graded THEN 'success' ELSE 'failure' END AS outcome FROM slots),
size AS (SELECT count(DISTINCT family) * 6 AS planned FROM runs)"""
# Successes of a family's six planned runs in each of two arms; nothing while a planned run of an arm is missing or ungraded.
_PAIRED = """gap AS (SELECT (SELECT planned FROM size) * 2 - (SELECT count(*) FROM led WHERE arm IN ('S1', 'S2') AND outcome <> 'ungraded') AS missing),
pd AS (SELECT family, 'factual' AS category, count(*) FILTER (arm = 'S1' AND outcome = 'success') AS reference_successes, count(*) FILTER (arm = 'S2' AND outcome = 'success') AS comparison_successes FROM led, gap WHERE missing = 0 GROUP BY family)"""
_LAT = "lat AS (SELECT lower(trim(name)) AS name, sample_id, series_id, latency_ms, raw_tokens, optimized_tokens, passed_exact_gate FROM run_sample WHERE latency_ms >= 0 AND NOT isnan(latency_ms))"


def _fired(patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches(t, {_q(p)})" for p in patterns)


def _policy() -> str:
    flags = []
    for reason in dict.fromkeys(r for r, _ in policy.RULES):
        flags.append("(" + " OR ".join(_fired(p) for r, p in policy.RULES if r == reason) + f") AS {reason}")
    return f"SELECT doc_id, {', '.join(flags)}, regexp_matches(t, {_q(policy.VISUAL)}) AS visual FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _classes(source: str, key: str, text: str) -> str:
    """Mode and reasons of texts: which rules fire, else visual words, else whether every line reads as a sentence."""
    fired = ", ".join(f"CASE WHEN {_fired(ps)} THEN '{r}' END" for r, ps in policy.RULES)
    ws = policy.WS
    trim = lambda c: f"regexp_replace(regexp_replace({c}, '^{ws}+', ''), '{ws}+$', '')"
    sentence = (
        r"length(regexp_replace(l, '[^\p{L}]', '', 'g')) >= 0.6 * length(l) AND regexp_matches(l, '[.!?]$') AND NOT regexp_matches(l, '[`{}\[\]|<>\\]')"
        r" AND len(regexp_extract_all(l, '\p{L}[\p{L}''-]*')) >= 5 AND NOT regexp_matches(l, '\b[A-Z_]{2,}\b')"
    )
    return f"""src AS (SELECT {key}, coalesce({text}, '') AS t FROM {source}),
rules AS (SELECT {key}, t, list_filter([{fired}], lambda r: r IS NOT NULL) AS fired, regexp_matches(t, {_q(policy.VISUAL)}) AS visual, {trim("t")} AS body FROM src),
said AS (SELECT *, list_filter(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {trim("x")}), lambda x: x <> '') AS ls FROM rules),
classes AS (SELECT {key}, t, CASE WHEN len(fired) > 0 THEN 'exact' WHEN visual THEN 'visual' WHEN {_units("body")} >= 24 AND len(ls) > 0 AND len(list_filter(ls, lambda l: NOT ({sentence}))) = 0 THEN 'semantic' ELSE 'unknown' END AS mode,
  list_filter(fired, lambda r, i: list_position(fired, r) = i) AS reasons FROM said)"""


def _json_hash(kind: str, *parts: str) -> str:
    return f"sha256('[\"{ALGORITHM}\",\"{SEED}\",\"{kind}\",' || " + " || ',' || ".join(parts) + " || ']')"


_JS_SPAN = f"""WITH {_BEST}, m AS (SELECT doc_id, line, text, delimiter, {_units("text")} AS u, {_cjk("text")} AS c, {_words("text")} AS w, length(delimiter) AS dl, strlen(text) AS b, strlen(delimiter) AS db FROM parts),
p AS (SELECT *, sum(u) OVER o AS su, sum(c) OVER o AS sc, sum(w) OVER o AS sw, sum(dl) OVER o AS sd, sum(b + db) OVER o AS sb FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
a AS (SELECT doc_id, min(best.line) AS anchor, max(n) AS n FROM best JOIN (SELECT doc_id, max(line) AS n FROM parts GROUP BY 1) USING (doc_id) GROUP BY 1),
w0 AS (SELECT *, least(2, anchor - 1) AS l0, least(2, n - anchor) AS r0 FROM a),
cand AS (SELECT *, greatest(t - r0, least(l0, t // 2)) AS l FROM (SELECT *, unnest(range(0, l0 + r0 + 1)) AS t FROM w0)),
span AS (SELECT doc_id, t, anchor - l AS i, anchor + t - l AS j FROM cand),
cost AS (SELECT s.doc_id, t, i, j, x.sb - x.b - x.db AS start_byte, y.sb - y.db AS end_byte, (y.su - x.su + x.u) + (y.sd - y.dl) - (x.sd - x.dl) AS u, y.sc - x.sc + x.c AS c, y.sw - x.sw + x.w AS w
  FROM span s JOIN p x ON x.doc_id = s.doc_id AND x.line = i JOIN p y ON y.doc_id = s.doc_id AND y.line = j),
fit AS (SELECT *, {_tokens("u", "c", "w")} AS tokens FROM cost)
SELECT doc_id, i::INTEGER AS start_line, j::INTEGER AS end_line, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t DESC) AS k FROM fit WHERE tokens <= {BUDGET}) WHERE k = 1"""

_U32 = "& 4294967295"
_MUL = "(({a})::UBIGINT * ({b})::UBIGINT & 4294967295)"


def _mulberry(seed: int, draw: str) -> str:
    """Nested subquery columns a -> t1 -> t2 -> u of the counter-based generator."""
    return f"""SELECT i, k, xor(t2, t2 >> 14) AS u FROM (SELECT i, k, xor(t1, (t1 + {_MUL.format(a="xor(t1, t1 >> 7)", b="t1 | 61")}) {_U32}) AS t2 FROM (
  SELECT i, k, {_MUL.format(a="xor(a, a >> 15)", b="a | 1")} AS t1 FROM (SELECT i, k, ({seed} + {_MUL.format(a=draw, b="1831565813")}) {_U32} AS a FROM grid)))"""


_LANG = "CASE WHEN lower(trim(lang)) IN ('en', 'eng') THEN 'en' WHEN lower(trim(lang)) IN ('ko', 'kor') THEN 'ko' WHEN lower(trim(lang)) IN ('de', 'ger', 'deu') THEN 'de' ELSE 'other' END"


def _label(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({c})), '[.\s]+$', ''), '[\s_-]+', '_', 'g')"


_VERIFY = f"v AS (SELECT item_id, kind, {_label('claude_label')} AS claude_label, {_label('openai_label')} AS openai_label, {_label('final_label')} AS final_label FROM (SELECT DISTINCT * FROM verify))"
_GRADED = f"""graded AS (SELECT condition_code AS arm, t.attempt_id, t.turn, template AS family, question, CASE WHEN turn_type LIKE 'late%' THEN 'late' WHEN turn_type LIKE 'immediate%' THEN 'immediate' ELSE turn_type END AS condition, coalesce(tool_calls, 0) > 0 AS matched,
  CASE WHEN answer IS NULL THEN 'failed' ELSE 'answered' END AS outcome, t.answer, coalesce(hit, false) AS correct, {_est("concat_ws(' ', question, answer)")}::BIGINT AS tokens, coalesce(originals_requested, 0) * 0.5::DOUBLE + 0.25::DOUBLE AS cost
  FROM turns t LEFT JOIN hits h ON t.attempt_id = h.attempt_id AND t.turn = h.turn WHERE condition_code IS NOT NULL),
orig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, question, condition ORDER BY attempt_id || '/' || lpad(turn::VARCHAR, 6, '0')) AS k FROM graded WHERE arm = 'S0') WHERE k = 1),
two AS (SELECT c.condition, c.outcome AS co, c.correct AS cc, c.tokens AS ct, c.cost AS cm, a.outcome AS ao, a.correct AS ac, a.tokens AS t2, a.cost AS m2, a.arm IS NOT NULL AS known, c.matched, c.outcome = 'answered' AND contains(lower(coalesce(c.answer, '')), 'unreadable') AS unread
  FROM graded c LEFT JOIN orig a ON c.family = a.family AND c.question = a.question AND c.condition = a.condition WHERE c.arm = 'S2'),
again AS (SELECT 'S2R' AS arm, condition, co AS outcome, CASE WHEN unread AND known THEN 'unreadable' END AS fallback, CASE WHEN unread AND known THEN ac ELSE cc END AS correct, ct + CASE WHEN unread AND known THEN t2 ELSE 0 END AS tokens, cm + CASE WHEN unread AND known THEN m2 ELSE 0 END AS cost FROM two),
window_arm AS (SELECT 'S2p' AS arm, condition, CASE WHEN NOT known THEN 'not_started' WHEN NOT matched OR unread THEN ao ELSE co END AS outcome, CASE WHEN NOT known THEN NULL WHEN NOT matched THEN 'no_window' WHEN unread THEN 'unreadable' END AS fallback,
  CASE WHEN known AND (NOT matched OR unread) THEN ac ELSE cc END AS correct, CASE WHEN known AND NOT matched THEN t2 WHEN known AND unread THEN ct + t2 ELSE ct END AS tokens, CASE WHEN known AND NOT matched THEN m2 WHEN known AND unread THEN cm + m2 ELSE cm END AS cost FROM two)"""

ORACLES = {
    "token_estimate": f"SELECT doc_id, {_est('text')} AS tokens FROM documents",
    "budget_fit": f"SELECT doc_id, tokens, coalesce(tokens <= 400, true) AS fits FROM (SELECT doc_id, {_est('text')} AS tokens FROM documents)",
    "token_by_lang": f"SELECT {_LANG} AS lang, count(*) AS documents, sum({_est('text')})::BIGINT AS tokens FROM documents GROUP BY 1",
    "line_index": f"""WITH {_LINES} SELECT doc_id, line, (e - strlen(text) - strlen(delimiter))::BIGINT AS start_byte, (e - strlen(delimiter))::BIGINT AS end_byte, text, delimiter
FROM (SELECT *, sum(strlen(text) + strlen(delimiter)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS e FROM parts)""",
    "line_map_agreement": f"""WITH art AS (SELECT DISTINCT artifact_id, content FROM artifact_record), {_raw("art", "artifact_id", "content")},
own AS (SELECT artifact_id, line, (e - strlen(text) - strlen(delimiter))::BIGINT AS start_byte, (e - strlen(delimiter))::BIGINT AS end_byte, text, delimiter
  FROM (SELECT *, sum(strlen(text) + strlen(delimiter)) OVER (PARTITION BY artifact_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS e FROM parts)),
told AS (SELECT DISTINCT artifact_id, line, start_byte, end_byte, text, delimiter FROM source_line)
SELECT (SELECT count(*) FROM (SELECT * FROM own INTERSECT SELECT * FROM told)) AS equal, (SELECT count(*) FROM (SELECT * FROM own EXCEPT SELECT * FROM told)) AS extra, (SELECT count(*) FROM (SELECT * FROM told EXCEPT SELECT * FROM own)) AS missing""",
    "artifact_ids": r"""SELECT doc_id, 'artifact_' || sha256(path || chr(0) || h)[1:16] AS artifact_id, h AS sha256, regexp_extract(path, '([^/\\]*)[/\\]*$', 1) || ' ' || h[1:12] AS label, strlen(t)::BIGINT AS byte_length,
  len(regexp_extract_all(t, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+'))::BIGINT AS line_count FROM (SELECT doc_id, path, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents)""",
    "line_stats": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT regexp_matches(text, '[^{WS}]')) AS blank_lines, max(length(text))::INTEGER AS longest FROM parts GROUP BY doc_id",
    "duplicate_content": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "split_leakage": "SELECT doc_id, family_id, doc_id % 5 AS split FROM (SELECT *, first_value(doc_id % 5) OVER (PARTITION BY family_id ORDER BY doc_id) AS f FROM documents WHERE family_id IS NOT NULL) WHERE doc_id % 5 <> f",
    "term_score_lines": f"WITH {_BEST} SELECT doc_id, line, score FROM sc WHERE score > 0",
    "best_line_ties": f"WITH {_BEST} SELECT doc_id, line, score FROM best",
    "omitted_matches": f"WITH {_BEST}, o AS (SELECT doc_id, line FROM (SELECT doc_id, line, min(line) OVER (PARTITION BY doc_id) AS f FROM best) WHERE line > f + 2) SELECT doc_id, count(*) AS omitted, array_to_string(list_slice(list(line ORDER BY line), 1, 20), ',') AS lines FROM o GROUP BY doc_id",
    "first_excerpt": _JS_SPAN,
    "merge_spans": f"WITH {_SPANS} SELECT doc_id, start_line, end_line, merged FROM merged",
    "gold_containment": f"WITH {_SPANS} SELECT p.doc_id, p.line, m.start_line, m.end_line FROM parts p JOIN merged m ON p.doc_id = m.doc_id AND p.line BETWEEN m.start_line AND m.end_line WHERE contains(lower(p.text), 'packing list')",
    "span_overlaps": f"WITH {_SPANS} SELECT m.doc_id, m.start_line AS l_start, m.end_line AS l_end, p.line AS r_start, p.line + 1 AS r_end FROM parts p JOIN merged m ON p.doc_id = m.doc_id AND m.start_line <= p.line + 1 AND p.line <= m.end_line WHERE length(p.text) > 200",
    "summary_prefix": f"""WITH {_LINES}, m AS (SELECT doc_id, line, text, {_units("text")} AS u, {_cjk("text")} AS c, {_words("text")} AS w FROM parts),
r AS (SELECT doc_id, line, text, sum(u) OVER o + line - 1 AS u, sum(c) OVER o AS c, sum(w) OVER o AS w FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, {_tokens("u", "c", "w")} AS tok FROM r),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (tok <= {BUDGET}) AS kept_lines, coalesce(max(tok) FILTER (tok <= {BUDGET}), 0)::INTEGER AS tokens, bool_or(tok > {BUDGET} AND regexp_matches(text, '[^{WS}]')) AS l,
  coalesce(sum(length(text)) FILTER (tok <= {BUDGET}), 0) AS ch FROM t GROUP BY doc_id)
SELECT doc_id, n_lines, kept_lines, tokens, (kept_lines > 0 AND l) AS truncated, CASE WHEN kept_lines = 0 THEN 'summary_span_exceeds_budget' END AS fallback_reason, (CASE WHEN kept_lines = 0 THEN 0 ELSE ch + kept_lines - 1 END)::INTEGER AS summary_chars FROM g
UNION ALL SELECT doc_id, 0, 0, 0, false, NULL, 0 FROM documents WHERE coalesce(length(text), 0) = 0""",
    "policy_reasons": _policy(),
    "content_match": f"WITH {_TURNS}, {_MATCH} SELECT attempt_id, turn, coalesce(hit, false) AS correct, coalesce(contains(lower(answer), 'unreadable'), false) AS unreadable FROM turns LEFT JOIN hits USING (attempt_id, turn)",
    "outcome_class": f"WITH {_RUNS} SELECT arm, outcome, count(*) AS runs FROM runs GROUP BY ALL",
    "arm_report": f"""WITH {_RUNS}, {_LEDGER}, arms(arm) AS (VALUES ('S0'), ('S1'), ('S2'), ('S3'), ('S4'), ('S9')),
per AS (SELECT arm, count(*) AS submitted, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'ungraded') AS ungraded, list_sum(list(cost ORDER BY cost)) AS c, count(latency) AS latency_n,
  quantile_disc(latency, 0.5) AS median_latency, quantile_disc(latency, 0.95) AS p95_latency FROM led GROUP BY arm),
k AS (SELECT arm, (SELECT planned FROM size)::BIGINT AS planned, coalesce(submitted, 0) AS submitted, coalesce(successes, 0) AS successes, coalesce(ungraded, 0) AS ungraded, c, coalesce(latency_n, 0) AS latency_n, median_latency, p95_latency FROM arms LEFT JOIN per USING (arm))
SELECT arm, planned, submitted, planned - submitted AS missing, ungraded, successes, submitted - successes - ungraded AS failures, (planned = submitted AND ungraded = 0) AS complete, CASE WHEN ungraded = 0 THEN round(successes / planned::DOUBLE, 9) END AS success_rate,
  CASE WHEN planned = submitted THEN c END AS total_cost, CASE WHEN planned = submitted AND ungraded = 0 AND successes > 0 THEN round(c / successes, 9) END AS cost_per_success, latency_n, median_latency, p95_latency FROM k""",
    "paired_diff": f"WITH {_RUNS}, {_LEDGER}, {_PAIRED} SELECT family, category, reference_successes, comparison_successes, round(reference_successes / 6.0::DOUBLE, 9) AS reference_rate, round(comparison_successes / 6.0::DOUBLE, 9) AS comparison_rate, round((comparison_successes - reference_successes) / 6.0::DOUBLE, 9) AS difference FROM pd",
    "point_estimate": f"WITH {_RUNS}, {_LEDGER}, {_PAIRED} SELECT count(*) AS families, round(sum(comparison_successes - reference_successes) / (6.0::DOUBLE * count(*)), 9) AS point_estimate FROM pd",
    "bootstrap_ci": f"""WITH {_RUNS}, {_LEDGER}, {_PAIRED}, ds AS (SELECT row_number() OVER (ORDER BY family) - 1 AS j, (comparison_successes - reference_successes) / 6.0::DOUBLE AS d FROM pd), n AS (SELECT count(*) AS n FROM ds),
grid AS (SELECT x // n AS i, x % n AS k, x + 1 AS m FROM n, unnest(range(0, {ROUNDS} * n)) t(x)),
draws AS ({_mulberry(BOOT_SEED, "(k + i * (SELECT n FROM n) + 1)")}),
ms AS (SELECT i, sum(d) / any_value(n) AS mean FROM (SELECT i, floor(u / 4294967296.0::DOUBLE * n)::BIGINT AS j, n FROM draws, n) JOIN ds USING (j) GROUP BY i),
o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM ms)
SELECT round((SELECT mean FROM o WHERE r = {int(0.025 * ROUNDS)}), 9) AS lo, round((SELECT mean FROM o WHERE r = {-int(-0.975 * ROUNDS // 1) - 1}), 9) AS hi""",
    "grouping_sets": f"WITH {_RUNS} SELECT arm, family, count(*) AS runs, round(avg(CASE WHEN outcome = 'success' THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS accuracy FROM runs GROUP BY GROUPING SETS ((arm, family), (arm), (family), ())",
    "turn_groups": f"WITH {_TURNS} SELECT CASE WHEN turn_type LIKE 'late%' THEN 'late' WHEN turn_type LIKE 'immediate%' THEN 'immediate' ELSE turn_type END AS turn_group, condition_code, count(*) AS turns, count(*) FILTER (threshold_exceeded) AS exceeded, sum(tool_calls)::BIGINT AS tool_calls, sum(originals_requested)::BIGINT AS originals FROM turns GROUP BY ALL",
    "two_level_mean": f"WITH {_RUNS}, p AS (SELECT arm, family, avg(CASE WHEN outcome = 'success' THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM runs GROUP BY ALL) SELECT arm, round(avg(s), 9) AS mean_score FROM p GROUP BY arm",
    "dataset_issues": r"""WITH r AS (SELECT doc_id AS idx, doc_id - (doc_id % 997 = 0)::INT AS id, family_id, doc_id % 5 AS split, doc_id % 11 = 0 AS ex, doc_id % 22 = 0 AS rx, coalesce(text, '') AS t, doc_id % 101 = 0 AS bad,
  sha256(regexp_replace(nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g')) AS h FROM documents),
f AS (SELECT *, first_value(split) OVER (PARTITION BY family_id ORDER BY idx) AS fs, first_value(family_id) OVER (PARTITION BY h ORDER BY idx) AS ff, row_number() OVER (PARTITION BY id ORDER BY idx) AS k FROM r)
SELECT idx, 'rubric_category_mismatch' AS code FROM f WHERE ex <> rx UNION ALL SELECT idx, 'source_hash_mismatch' FROM f WHERE bad UNION ALL SELECT idx, 'duplicate_id' FROM f WHERE k > 1
UNION ALL SELECT idx, 'family_split_leakage' FROM f WHERE family_id IS NOT NULL AND split IS DISTINCT FROM fs UNION ALL SELECT idx, 'source_family_conflict' FROM f WHERE family_id IS DISTINCT FROM ff""",
    "pilot_quota": f"""WITH f AS (SELECT family_id, arg_min({_LANG}, doc_id) AS category, min(doc_id) % 3 AS split FROM documents WHERE family_id IS NOT NULL GROUP BY family_id),
a AS (SELECT category, split, count(*) AS actual FROM f GROUP BY ALL), e AS (SELECT category, split::BIGINT AS split, 20::BIGINT AS expected FROM (VALUES ('en'), ('ko'), ('de'), ('fr'), ('other')) c(category), range(0, 3) t(split))
SELECT category, split, expected, coalesce(actual, 0) AS actual FROM e LEFT JOIN a USING (category, split) WHERE coalesce(actual, 0) <> expected""",
    "model_inputs": f"WITH {_TURNS} SELECT attempt_id || '-' || turn AS id, 'en' AS language, template AS text, question FROM turns WHERE turn % 2 = 0",
    "seeded_schedule": f"""WITH {_TURNS}, f AS (SELECT DISTINCT template AS family FROM turns), t AS (SELECT family, l AS language, family || '-' || l AS task FROM f, (VALUES ('en'), ('ko')) x(l)),
s AS (SELECT *, unnest(range(1, 4)) AS attempt FROM t), a AS (SELECT s.*, arm FROM s, (VALUES {", ".join(f"('{x}')" for x in ARMS)}) y(arm)),
h AS (SELECT *, {_json_hash("family", "chr(34) || family || chr(34)")} AS hf, {_json_hash("arm", "chr(34) || task || chr(34)", "attempt::VARCHAR", "chr(34) || arm || chr(34)")} AS ha FROM a)
SELECT row_number() OVER (ORDER BY hf, family, language, task, attempt, ha, arm)::INTEGER AS ordinal, family, task, language, attempt::INTEGER AS attempt, arm FROM h""",
    "mock_run": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_orderkey % 50 + 1 AS dur, floor(o_totalprice::DOUBLE / 1000)::BIGINT AS res, CASE WHEN o_orderkey % 37 <> 0 THEN floor(o_totalprice::DOUBLE / 990)::BIGINT END AS st FROM orders),
p AS (SELECT *, coalesce(sum(dur) OVER b, 0)::BIGINT AS t, coalesce(sum(st) OVER b, 0)::BIGINT AS c FROM o WINDOW b AS (PARTITION BY o_custkey ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, 150 - t AS rem, least(45, 150 - t) AS dl, (150 - t <= 0 OR res > 900 - c) AS off FROM p),
w AS (SELECT *, CASE WHEN rem <= 0 THEN 'run_timeout' WHEN res > 900 - c THEN 'budget_exhausted' WHEN dur >= dl AND rem <= 45 THEN 'run_timeout' WHEN dur >= dl THEN 'request_timeout' WHEN st IS NULL THEN 'unknown_cost' WHEN st > res THEN 'reservation_exceeded' END AS why FROM q),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ordinal) AS k FROM w WHERE why IS NOT NULL) WHERE k = 1),
g AS (SELECT o_custkey, count(*) AS planned, sum(dur) AS dt, sum(st) AS ac FROM o GROUP BY 1)
SELECT g.o_custkey, planned, (CASE WHEN why IS NULL THEN planned WHEN off THEN ordinal - 1 ELSE ordinal END)::BIGINT AS started, coalesce(why, 'schedule_exhausted') AS stop_reason,
  (CASE WHEN why IS NULL THEN dt WHEN off THEN t WHEN dur >= dl THEN t + dl ELSE t + dur END)::BIGINT AS elapsed_ms,
  (CASE WHEN why IS NULL THEN ac WHEN off OR dur >= dl THEN c ELSE c + coalesce(st, 0) END)::BIGINT AS known_cost,
  (CASE WHEN why IS NULL THEN ac WHEN off THEN c WHEN dur >= dl OR st IS NULL THEN NULL ELSE c + st END)::BIGINT AS settled_cost,
  (CASE WHEN why IS NOT NULL AND NOT off AND (dur >= dl OR st IS NULL) THEN res ELSE 0 END)::BIGINT AS held FROM g LEFT JOIN s ON g.o_custkey = s.o_custkey""",
    "exact_check": f"""WITH {_TURNS} SELECT attempt_id || '-' || turn AS task_id, code, CASE WHEN code IS NULL THEN true WHEN code = 'response_mismatch' THEN false END AS passed FROM (
  SELECT attempt_id, turn, CASE WHEN strlen(answer) > 65536 THEN 'invalid_input' WHEN turn = 5 THEN 'dataset_fingerprint_mismatch' WHEN turn % 4 = 0 THEN 'unsupported_task' WHEN turn = 7 THEN 'registry_drift'
    WHEN contains(gold[1], chr(10)) THEN 'source_fidelity_failure' WHEN answer <> gold[1] THEN 'response_mismatch' END AS code FROM turns WHERE len(gold) > 0 AND answer IS NOT NULL)""",
    "latency_nearest_rank": f"WITH {_LAT} SELECT name, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM lat GROUP BY name",
    "type7_quantiles": f"WITH {_LAT} SELECT name, round(quantile_cont(latency_ms, 0.025), 6) AS q25, round(quantile_cont(latency_ms, 0.5), 6) AS q500, round(quantile_cont(latency_ms, 0.975), 6) AS q975 FROM lat GROUP BY name",
    "sample_cv": f"WITH {_LAT} SELECT name, round(stddev_samp(latency_ms) / avg(latency_ms), 6) AS cv FROM lat GROUP BY name",
    "drift_halves": f"""WITH {_LAT}, b AS (SELECT name, floor(latency_ms * 1000)::BIGINT AS us, row_number() OVER (PARTITION BY name ORDER BY sample_id, latency_ms) AS i, count(*) OVER (PARTITION BY name) AS n FROM lat),
g AS (SELECT name, avg(us) FILTER (i <= ceil(n / 2.0::DOUBLE)) AS early, avg(us) FILTER (i > ceil(n / 2.0::DOUBLE)) AS late FROM b GROUP BY name)
SELECT name, round(early, 6) AS early, round(late, 6) AS late, round(late / early, 6) AS ratio FROM g""",
    "ordered_cost_sum": "SELECT l_orderkey, list_reduce(list_prepend(0.0::DOUBLE, list(l_extendedprice::DOUBLE ORDER BY l_extendedprice)), lambda a, x: a + x) AS total FROM lineitem GROUP BY l_orderkey",
    "token_reduction": f"WITH {_LAT}, g AS (SELECT name, sum(raw_tokens)::BIGINT AS raw, sum(optimized_tokens)::BIGINT AS optimized FROM lat GROUP BY name) SELECT name, raw, optimized, CASE WHEN raw = 0 THEN 0.0::DOUBLE ELSE floor((1 - optimized / raw::DOUBLE) * 1000 + 0.5) / 10 END AS reduction_pct FROM g",
    "conservative_gates": f"""WITH {_LAT}, s AS (SELECT name, series_id, sum(raw_tokens) AS raw, sum(optimized_tokens) AS optimized, bool_and(passed_exact_gate) AS passed FROM lat GROUP BY ALL),
r AS (SELECT *, CASE WHEN raw = 0 THEN 0.0::DOUBLE ELSE floor((1 - optimized / raw::DOUBLE) * 1000 + 0.5) / 10 END AS reduction FROM s),
w AS (SELECT *, CASE WHEN passed IS NULL THEN 'no_gate' WHEN NOT passed THEN 'gate_failed' WHEN reduction < 25 THEN 'small_reduction' END AS warning FROM r),
g AS (SELECT name, count(*) AS series, min(reduction) AS min_reduction, bool_and(coalesce(passed, false)) AS all_passed, bool_or(passed) AS any_passed, coalesce(string_agg(DISTINCT warning, ',' ORDER BY warning), '') AS warnings FROM w GROUP BY name),
p AS (SELECT name, quantile_disc(latency_ms, 0.95) AS p95 FROM lat GROUP BY name)
SELECT *, (p95 > 1000 OR NOT all_passed OR min_reduction < 25) AS fails FROM g JOIN p USING (name)""",
    "verdicts": f"""WITH {_LAT}, c AS (SELECT name, sample_id // 3 % 36 AS r, avg(us) FILTER (v = 0) AS a, avg(us) FILTER (v = 1) AS a2, avg(us) FILTER (v = 2) AS b FROM (SELECT name, sample_id, sample_id % 3 AS v, floor(latency_ms * 1000)::BIGINT AS us FROM lat) GROUP BY ALL),
k AS (SELECT name, r, b / ((a + a2) / 2) AS x, a2 / a AS y FROM c WHERE a > 0 AND a2 > 0 AND b > 0),
per AS (SELECT name, count(*) AS rounds, median(y) AS aa, list(x ORDER BY r) AS xs FROM k GROUP BY name), full_ AS (SELECT * FROM per WHERE rounds = 36),
grid AS (SELECT i, j, i * 6 + j + 1 AS m, i AS k FROM range(0, {ROUNDS}) a(i), range(0, 6) b(j)),
u AS ({_mulberry(BOOT_SEED, "m").replace("SELECT i, k,", "SELECT i, j,")}),
pick AS (SELECT i, list(floor(u / 4294967296.0::DOUBLE * 6)::BIGINT) AS bs FROM u GROUP BY i),
ms AS (SELECT name, i, list_median(flatten(list_transform(bs, lambda b: list_slice(xs, b * 6 + 1, b * 6 + 6)))) AS m FROM full_, pick),
ci AS (SELECT name, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ms GROUP BY name),
t AS (SELECT n.name, coalesce(rounds, 0)::BIGINT AS rounds, aa, CASE WHEN rounds = 36 THEN list_median(xs) END AS point, lo, hi FROM (SELECT DISTINCT name FROM lat) n LEFT JOIN per ON per.name = n.name LEFT JOIN ci ON ci.name = n.name)
SELECT name, rounds, round(aa, 9) AS aa, round(point, 9) AS point, round(lo, 9) AS lo, round(hi, 9) AS hi, CASE WHEN rounds <> 36 OR aa < 0.75 OR aa > 1.25 THEN 'INVALID' WHEN point > 1.1 THEN 'FAIL' WHEN hi > 1.1 THEN 'BORDERLINE' ELSE 'PASS' END AS verdict FROM t""",
    "percent_agreement": f"WITH {_VERIFY} SELECT kind, count(*) AS items, round(avg((claude_label = openai_label)::INT)::DOUBLE, 9) AS agreement FROM v WHERE claude_label IS NOT NULL AND openai_label IS NOT NULL GROUP BY kind",
    "label_crosstab": f"WITH {_VERIFY} SELECT claude_label, openai_label, count(*) AS items FROM v GROUP BY ALL",
    "paired_raters": f"WITH {_VERIFY} SELECT item_id, claude_label, openai_label, CASE WHEN claude_label = openai_label THEN claude_label ELSE final_label END AS settled FROM v WHERE claude_label IS NOT NULL AND openai_label IS NOT NULL",
    "audit_order": "SELECT DISTINCT item_id, sha256('order-v1|rater-01|' || item_id) AS rank_key FROM verify",
    "compaction_epochs": f"""WITH {_TURNS}, t AS (SELECT attempt_id, turn, {_est("coalesce(question, '')")} + {_est("coalesce(answer, '')")} AS tokens, (turn > 3)::INT + (turn > 6)::INT AS epoch FROM turns)
SELECT attempt_id, turn, epoch, sum(tokens) OVER (PARTITION BY attempt_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM t""",
    "cache_cost": f"""WITH {_TURNS}, u AS (SELECT condition_code, attempt_id, sum({_est("coalesce(question, '')")}) AS p, sum({_est("coalesce(answer, '')")}) AS c FROM turns WHERE condition_code IS NOT NULL GROUP BY ALL),
m AS (SELECT condition_code, avg(p) AS p, avg(c) AS c FROM u GROUP BY 1)
SELECT condition_code, round(p * 2.5::DOUBLE / 1e6 + c * 10.0::DOUBLE / 1e6, 9) AS list_cost, round((p - p * 0.5::DOUBLE - p * 0.25::DOUBLE + p * 0.5::DOUBLE * 0.5::DOUBLE + p * 0.25::DOUBLE * 1.25::DOUBLE) * 2.5::DOUBLE / 1e6 + c * 10.0::DOUBLE / 1e6, 9) AS cache_cost FROM m""",
    "missing_slots": f"WITH {_TURNS}, s AS (SELECT DISTINCT attempt_id FROM turns) SELECT attempt_id, n::INTEGER AS turn FROM s, range(1, 9) t(n) WHERE (attempt_id, n) NOT IN (SELECT (attempt_id, turn) FROM turns)",
    "latest_wins": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 AND event_type <> 'error' THEN 'ok' ELSE 'failed' END AS status FROM events)
SELECT user_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status = 'ok') DESC, CASE WHEN status = 'ok' THEN -event_id ELSE event_id END) AS k FROM e) WHERE k = 1""",
    "optional_key_join": f"""WITH {_TURNS}, r AS (SELECT session_id, condition_code, min(CASE WHEN record_id % 2 = 0 THEN attempt_id END) AS only_one FROM session_record GROUP BY ALL)
SELECT t.condition_code, count(*) AS turns, count(DISTINCT t.attempt_id) AS attempts FROM turns t JOIN r ON t.session_id = r.session_id AND t.condition_code = r.condition_code AND (only_one IS NULL OR only_one = t.attempt_id) GROUP BY ALL""",
    "stream_index": rf"""SELECT doc_id, 'artifact_' || sha256(path || chr(0) || sha256(t))[1:16] AS artifact_id, len(regexp_extract_all(t, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+'))::INTEGER AS line_count, {_est("t")} AS tokens FROM (SELECT doc_id, path, coalesce(text, '') AS t FROM documents)""",
    "graded_slots": f"""WITH {_TURNS}, e AS (SELECT attempt_id, turn, condition_code, regexp_replace({_norm("answer")}, 'region$', '') AS a, list_transform(coalesce(gold, []), lambda g: regexp_replace({_norm("g")}, 'region$', '')) AS gs FROM turns WHERE condition_code IS NOT NULL)
SELECT condition_code, count(*) AS slots, count(*) FILTER (list_contains(gs, a)) AS strict, count(*) FILTER (len(list_filter(gs, lambda g: contains(a, g))) > 0) AS content FROM e GROUP BY condition_code""",
    "question_keywords": f"WITH {_TURNS}, q AS (SELECT DISTINCT question FROM turns) SELECT question, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9\\- ]', ' ', 'g'), ' +'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'what', 'which', 'please', 'with')))), ' ') AS keywords FROM q",
    "slot_costs": f"WITH {_TURNS} SELECT attempt_id, turn, round(3 * ({_est("coalesce(question, '')")} * 2.5::DOUBLE + 600.0::DOUBLE) / 1e6, 9) AS cost FROM turns",
    "paired_conditions": f"""WITH {_RUNS}, p AS (SELECT arm, family, avg(CASE WHEN outcome = 'success' THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM runs GROUP BY ALL)
SELECT a.family, round(a.s, 9) AS a, round(b.s, 9) AS b, round(a.s - b.s, 9) AS diff FROM p a JOIN p b ON a.family = b.family AND a.arm = 'S2' AND b.arm = 'S0'""",
    "derived_arms": f"""WITH {_TURNS}, {_MATCH}, {_GRADED}, x AS (SELECT arm, outcome, NULL AS fallback, correct, tokens, cost FROM graded UNION ALL SELECT * EXCLUDE (condition) FROM again UNION ALL SELECT * EXCLUDE (condition) FROM window_arm)
SELECT arm, outcome, fallback, count(*) AS runs, count(*) FILTER (correct) AS correct, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost FROM x GROUP BY ALL""",
    "image_tokens": """WITH s(x) AS (VALUES (64), (256), (512), (768), (1000), (1092), (1536), (2049), (4096)), g AS (SELECT a.x::BIGINT AS w, b.x::BIGINT AS h FROM s a, s b),
f AS (SELECT w, h, floor(w * least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(w, h))) AS fw, floor(h * least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(w, h))) AS fh FROM g),
k AS (SELECT *, CASE WHEN least(fw, fh) > 768 THEN 768.0::DOUBLE / least(fw, fh) ELSE 1.0::DOUBLE END AS z FROM f),
l AS (SELECT w, h, unnest(range(1, least(1568, greatest(w, h)) + 1)) AS x FROM g),
c AS (SELECT w, h, x, ceil(x / 28.0::DOUBLE) * ceil(floor(x * (least(w, h) / greatest(w, h)::DOUBLE) + 0.5) / 28.0::DOUBLE) AS p FROM l),
b AS (SELECT w, h, arg_max(p, x) AS p FROM c WHERE p <= 1568 GROUP BY ALL)
SELECT k.w, k.h, (85 + 170 * ceil(floor(fw * z) / 512.0::DOUBLE) * ceil(floor(fh * z) / 512.0::DOUBLE))::BIGINT AS tiles,
  (CASE WHEN greatest(k.w, k.h) <= 1568 AND ceil(k.w / 28.0::DOUBLE) * ceil(k.h / 28.0::DOUBLE) <= 1568 THEN ceil(k.w / 28.0::DOUBLE) * ceil(k.h / 28.0::DOUBLE) ELSE coalesce(p, 0) END)::BIGINT AS patches FROM k LEFT JOIN b ON k.w = b.w AND k.h = b.h""",
    "overview_sizes": """WITH s(x) AS (VALUES (64), (256), (512), (768), (1000), (1092), (1536), (2049), (4096)), g AS (SELECT a.x::BIGINT AS w, b.x::BIGINT AS h, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(a.x, b.x)) AS z FROM s a, s b)
SELECT w, h, greatest(1, floor(w * z + 0.5))::INTEGER AS ow, greatest(1, floor(h * z + 0.5))::INTEGER AS oh FROM g""",
    "paired_incomplete": "SELECT template AS family, 0.0::DOUBLE AS difference FROM session_turn WHERE condition_code = 'S9'",
    "paired_coverage": f"""WITH {_RUNS}, {_LEDGER}, arms(arm) AS (VALUES ('S0'), ('S1'), ('S2'), ('S3'), ('S4'), ('S9'))
SELECT arms.arm, any_value(planned)::BIGINT AS planned, count(led.arm) AS submitted, (any_value(planned) - count(led.arm))::BIGINT AS missing, count(*) FILTER (outcome = 'ungraded') AS ungraded FROM size, arms LEFT JOIN led ON arms.arm = led.arm GROUP BY arms.arm""",
    "started_means": f"WITH {_TURNS}, {_MATCH}, {_GRADED} SELECT condition, count(*) AS runs, count(*) FILTER (outcome = 'not_started') AS not_started, round(avg(correct::INT) FILTER (outcome <> 'not_started')::DOUBLE, 9) AS accuracy FROM window_arm GROUP BY condition",
    "policy_mode": f"""WITH {_classes("documents", "doc_id", "text")}
SELECT doc_id, mode, CASE mode WHEN 'exact' THEN array_to_string(reasons, ',') WHEN 'visual' THEN 'visual_context' WHEN 'semantic' THEN 'natural_language' ELSE 'insufficient_semantic_signal' END AS reasons, mode = 'semantic' AS lossy_allowed FROM classes""",
    "policy_artifacts": f"""WITH one AS (SELECT artifact_id, content FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY indexed_at DESC) AS k FROM artifact_record) WHERE k = 1),
{_classes("one", "artifact_id", "content")} SELECT mode, count(*) AS artifacts FROM classes GROUP BY mode""",
    "gated_summary": f"""WITH {_classes("documents", "doc_id", "text")}, ok AS (SELECT doc_id, t AS text FROM classes WHERE mode = 'semantic'), {_raw("ok", "doc_id", "text")},
m AS (SELECT doc_id, line, text, {_units("text")} AS u, {_cjk("text")} AS c, {_words("text")} AS w FROM parts),
r AS (SELECT doc_id, line, text, sum(u) OVER o + line - 1 AS u, sum(c) OVER o AS c, sum(w) OVER o AS w FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, {_tokens("u", "c", "w")} AS tok FROM r),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (tok <= {BUDGET}) AS kept_lines, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (tok <= {BUDGET}), '') AS summary, coalesce(max(tok) FILTER (tok <= {BUDGET}), 0)::INTEGER AS tokens, bool_or(tok > {BUDGET} AND regexp_matches(text, '[^{WS}]')) AS l FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, kept_lines, summary, tokens, (kept_lines > 0 AND l) AS truncated, CASE WHEN kept_lines = 0 THEN 'summary_span_exceeds_budget' END AS fallback_reason FROM g
UNION ALL SELECT doc_id, NULL, 0, '', 0, false, mode || '_content_requires_source' FROM classes WHERE mode <> 'semantic'""",
    "query_variants": f"""WITH {_TURNS}, q AS (SELECT DISTINCT question FROM turns), w AS (SELECT question, list_transform(string_split_regex(question, '\\s+'), lambda x: regexp_replace(x, '[.:?]+$', '')) AS ws FROM q)
SELECT question, array_to_string(list_filter(ws, lambda x: x <> '' AND NOT list_contains(['the','a','an','of','to','in','on','at','is','are','was','were','be','what','which','how','why','please','with','and','or'], lower(x))), ' ') AS keywords,
  CASE WHEN len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN array_to_string(list_filter(ws, lambda x: regexp_matches(x, '[0-9]')), ' ') END AS entity FROM w""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
