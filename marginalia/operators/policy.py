"""Which texts may be shortened: exact, visual, semantic or unknown.

The rules are regular expressions for a linear-time engine (RE2 through Arrow, whole batches at a
time), so no input can make a rule blow up; none needs look-around.  All rules run, since all reasons
are wanted; a text without an exact reason is visual by its words, else semantic when every line
reads as a sentence, else unknown.

Defined results: null texts are empty texts, which are unknown; texts are read whole.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pieces and rules below must match exactly what the contract says.
WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_IN_LINE = r"[\t\x{000B}\x{000C} \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_SAME_LINE = r"[\t\x{000B}\x{000C} \x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
INK = r"[^\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_START = r"(?:^|[\n\r\x{2028}\x{2029}])"
LABEL_END = rf"(?:\*{{1,3}}|[\"')”’）」』])?{WS}*[:=：]"
COMMANDS = "npm node git pnpm yarn cargo go python pytest curl echo copy cp mv rm mkdir cat grep rg sed awk ssh scp docker kubectl make".split()
SHELL_COMMANDS = [*COMMANDS, "systemctl", "terraform"]
EXTENSIONS = "ts tsx js jsx json py go rs java cs md ya?ml toml ini conf cfg env html css sql db sh".split()

_ANY = "|".join
_OPEN, _SHUT = r"[(\"'`]*", r"[).,;\"'`]*"
_ASSIGN = rf"{_OPEN}[A-Za-z_][A-Za-z0-9_]*={INK}*"
_DOTTED = r"\b[\p{L}\p{N}][\p{L}\p{N}_-]+\.[A-Za-z0-9]{1,12}\b"
_SNAKE = r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b"
_TRACE = r"(?i)\b(?:trace|span|correlation|request|session|event){ws}*(?:[:=]{ws}*)?[A-Za-z0-9._-]{{6,}}\b"
_RUN = r"(?i)\b(?:run|execute|invoke){ws}+[a-z][a-z0-9._-]*"
_ARGUMENT = (
    r"(?i)\b[a-z][a-z0-9._-]*{ws}+(?:[ugoa]*[+=-][rwxstugo,]+|--?[a-z0-9][a-z0-9-]*|[a-z_][a-z0-9_]*=|\.{{0,2}}/|~/|[a-z]:[\\/]|"
    r"[a-z][a-z0-9._-]*/|(?:apply|build|clone|deploy|install|merge|pull|push|release|restart|test|upgrade))\b"
)

#: (reason, patterns): the reason holds when any pattern does.
RULES: list[tuple[str, list[str]]] = [
    ("secret", [
        rf"(?i)\b(?:api[_-]?key|token|password|secret|private[_-]?key)\b{LABEL_END}",
        rf"(?i)\b(?:passwd|pwd|passphrase|pass|passcode|pass(?:[ \t]+|-)phrase|credentials?|(?:private|secret|access|api)(?:[ \t]+|-)key|client(?:[ \t]+|-)secret|recovery(?:[ \t]+|-)codes?|secret(?:[ \t]+|-)answer|backup(?:[ \t]+|-)codes?)\b{LABEL_END}",
        rf"(?:비밀[ \t]?번호|비번|패스[ \t]?워드|인증[ \t]?키|개인[ \t]?키|비밀[ \t]?키|시크릿[ \t]?키|액세스[ \t]?키|복구[ \t]?코드|백업[ \t]?코드|인증[ \t]?토큰|접근[ \t]?토큰|액세스[ \t]?토큰|암호|토큰|보안[ \t]?코드){LABEL_END}",
        rf"(?i)(?:^|[^A-Za-z0-9])api[ \t]?키{LABEL_END}",
    ]),
    ("secret", [rf"(?i)\bAuthorization{WS}*:{WS}*Bearer{WS}+[A-Za-z0-9._~+/=-]+"]),
    ("secret", [rf"\bBearer{WS}+[A-Za-z0-9._~+/=-]{{8,}}"]),
    ("secret", [rf"\b[A-Za-z][A-Za-z0-9+.-]*:{INK}"]),
    ("secret", [r"-----BEGIN [A-Z ]*PRIVATE KEY-----"]),
    ("code_or_path", [rf"(?:^|{WS})(?:[A-Za-z]:[\\/]|~/|\.{{1,2}}/|/[A-Za-z0-9._-]+/|\\\\)"]),
    ("code_or_path", [_DOTTED]),
    ("code_or_path", [rf"\b[A-Za-z0-9_.-]+\.(?:{_ANY(EXTENSIONS)})(?::[0-9]+(?::[0-9]+)?)?\b"]),
    ("code_or_path", [rf"(?:^|{WS})[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+(?:{WS}|$|[).,;:])"]),
    ("code_or_path", [r"(?i)\b(?:error|exception|traceback|stack trace|diff --git|@@)\b"]),
    ("code_or_path", [rf"(?i){LINE_START}{WS_SAME_LINE}*(?:(?:sudo|doas){WS}+)?(?:{_ANY(COMMANDS)})\b"]),
    ("code_or_path", [_RUN.format(ws=WS)]),
    ("code_syntax", [rf"{LINE_START}{WS_SAME_LINE}*(?:import|export|const|let|var|return|function|class|interface|type|if|for|while|try|catch)\b"]),
    ("code_syntax", [r"(?s)\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|CREATE|ALTER|DROP)\b.*\b(?:FROM|WHERE|SET|VALUES|TABLE)\b"]),
    ("code_syntax", [r"(?s)[{};].*[=().]"]),
    ("code_syntax", [r"<![A-Za-z][^>]*>"]),
    ("code_syntax", [r"(?s)<\?[A-Za-z].*?\?>"]),
    ("code_syntax", [r"(?s)<!--.*?-->"]),
    ("code_syntax", [rf"</?[A-Za-z][A-Za-z0-9-]*(?:{WS}+[^<>]*)?>"]),
    ("identifier_or_hash", [rf"(?i)\b(?:sha256|sha|hash|id){WS}*[:=]{WS}*[A-Za-z0-9._-]{{4,}}\b"]),
    ("identifier_or_hash", [rf"(?i)\b[A-Za-z][A-Za-z0-9_-]*[-_]id{WS}*(?:[:=]{WS}*)?[A-Za-z0-9._-]{{6,}}\b"]),
    ("identifier_or_hash", [_TRACE.format(ws=WS)]),
    ("identifier_or_hash", [_SNAKE]),
    ("identifier_or_hash", [r"\b[A-Fa-f0-9]{32}[A-Fa-f0-9]*\b"]),
    ("identifier_or_hash", [r"\b[A-Z]{2,}[-_][A-Z0-9]{3,}\b"]),
    ("numeric_or_table", [rf"(?:^|\n){WS}*\|[^\n\r\x{{2028}}\x{{2029}}]+\|{WS}*(?:\n|$)"]),
    ("numeric_or_table", [r"(?i)\b[0-9]+(?:\.[0-9]+)?(?:ms|s|MB|GB|KiB|MiB|%|tokens?)?\b"]),
    ("code_or_path", [
        rf"(?i)(?:^|[\n\r]){WS_IN_LINE}*(?:(?:{_ASSIGN}|{_OPEN}(?:sudo|doas){_SHUT}(?:{WS_IN_LINE}+{_OPEN}-{INK}*(?:{WS_IN_LINE}+{INK}+)?)*|"
        rf"{_OPEN}env{_SHUT}(?:{WS_IN_LINE}+(?:{_OPEN}-{INK}*|{_ASSIGN}))*){WS_IN_LINE}+)*{_OPEN}(?:{_ANY(SHELL_COMMANDS)}){_SHUT}(?:{WS}|$)",
    ]),
    ("code_or_path", [_DOTTED, _SNAKE, _RUN.format(ws=WS_IN_LINE), _ARGUMENT.format(ws=WS_IN_LINE), _TRACE.format(ws=WS_IN_LINE)]),
]
VISUAL = r"(?i)\b(?:screenshot|diagram|chart|layout|image|visual)\b"
WARNINGS = {"exact": ["lossy_compression_not_allowed"], "visual": ["lossy_summary_not_allowed_for_visual"], "semantic": [], "unknown": ["lossy_compression_not_allowed"]}
OTHER_REASONS = {"visual": "visual_context", "semantic": "natural_language", "unknown": "insufficient_semantic_signal"}
N = len(RULES)
VISUAL_BIT, SEMANTIC_BIT = 1 << N, 1 << (N + 1)

_TRIM = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def _sentence(line: str) -> bool:
    letters = sum(map(str.isalpha, line))
    if letters < 0.6 * len(line) or line[-1] not in ".!?" or any(c in "`{}[]|<>\\" for c in line):
        return False
    words, inside = 0, False
    for ch in line:
        alpha = ch.isalpha()
        words += alpha and not inside
        inside = alpha or inside and ch in "'-"
    if words < 5:
        return False
    run, before = 0, False
    for ch in line + " ":  # a run of capitals and underscores between ASCII word boundaries
        word = ch.isascii() and (ch.isalnum() or ch == "_")
        if word and (ch.isupper() or ch == "_"):
            run += not before
            run += bool(run) and before
        else:
            if run >= 2 and not word:
                return False
            run = 0 if not word else -10**6
        if not word:
            run = 0
        before = word
    return True


def reads_as_prose(text: str) -> bool:
    """Whether every line that isn't blank reads as a sentence (of a text without exact reasons)."""
    body = text.strip(_TRIM)
    if len(body) + sum(ch > "\uffff" for ch in body) < 24:
        return False
    lines = [s for s in (x.strip(_TRIM) for x in body.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if s]
    return bool(lines) and all(map(_sentence, lines))


def fired_rules(texts: pa.Array) -> pa.Array:
    """Bit i for rule i, then a bit each for visual words and for prose."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bits = pa.array([0] * len(texts), pa.int64())
    for i, (_, patterns) in enumerate(RULES):
        hit = None
        for p in patterns:
            m = pc.match_substring_regex(texts, p)
            hit = m if hit is None else pc.or_(hit, m)
        bits = pc.bit_wise_or(bits, pc.multiply(hit.cast(pa.int64()), 1 << i))
    bits = pc.bit_wise_or(bits, pc.multiply(pc.match_substring_regex(texts, VISUAL).cast(pa.int64()), VISUAL_BIT))
    out = [b | SEMANTIC_BIT if b == 0 and reads_as_prose(t) else b for b, t in zip(bits.to_pylist(), texts.to_pylist())]
    return pa.array(out, pa.int64())


def rule_bits(text: Column) -> Column:
    """Column of fired rules; Arrow batches into RE2, no row-wise Python regex."""
    return F.arrow_udf(fired_rules, "bigint")(text)


def has_rule(bits: Column, i: int) -> Column:
    return F.shiftright(bits, i).bitwiseAND(F.lit(1)) == 1


def mode_of(bits: Column) -> Column:
    exact = bits.bitwiseAND(F.lit((1 << N) - 1)) != 0
    return F.when(exact, "exact").when(bits.bitwiseAND(F.lit(VISUAL_BIT)) != 0, "visual").when(bits.bitwiseAND(F.lit(SEMANTIC_BIT)) != 0, "semantic").otherwise("unknown")


def reasons_of(bits: Column) -> Column:
    """Distinct reasons in the rules' order."""
    fired = F.array(*[F.when(has_rule(bits, i), F.lit(r)) for i, (r, _) in enumerate(RULES)])
    other = F.create_map(*[F.lit(x) for kv in OTHER_REASONS.items() for x in kv])[mode_of(bits)]
    return F.when(mode_of(bits) == "exact", F.array_distinct(F.array_compact(fired))).otherwise(F.array(other))


def classify(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, mode, reasons, warnings, lossy_allowed``; only the key and text columns are read."""
    d = docs.select(key, rule_bits(F.col(text)).alias("_b"))
    mode = mode_of(F.col("_b"))
    warnings = F.create_map(*[x for m, w in WARNINGS.items() for x in (F.lit(m), F.array(*map(F.lit, w)) if w else F.array().cast("array<string>"))])
    return d.select(key, mode.alias("mode"), reasons_of(F.col("_b")).alias("reasons"), warnings[mode].alias("warnings"), (mode == "semantic").alias("lossy_allowed"))
