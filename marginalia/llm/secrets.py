"""Credentials in source code and configuration: find them, and mask them in place.

Files are cut into chunks of whole lines.  A trigram index keeps, for each trigram that some
detection regex requires, the chunks that have it (the *postings*).  The requirement of a regex is
derived from its own parse tree (``required_trigrams``), so a new rule needs no hand-written key
words.  Postings are intersected to candidate (chunk, rule) pairs, and only there the regexes run.
Each batch of files is indexed, intersected and verified where it lies, so its contents aren't moved
again; ``build_trigram_index`` writes the same postings as a table for an index that is to be kept.

Defined results: null or empty contents have no lines and no credentials; LF, CRLF and lone CR end a
line; a byte order mark belongs to the first line; several deliveries of an artifact count as one
(the last by ``indexed_at``); equal files under several ids are reported under each.  A line is
never cut, so a chunk is as long as its longest line needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as sre  # the standard library's own regex parser
from re import _parser as sre_parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_LINES = 48
_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")

# ---------------------------------------------------------------- names and values

# Last parts of an identifier that names a credential.
_ONE = frozenset(
    "password passwd pwd passphrase passcode pass pw secret token credential credentials bearer jwt apikey auth "
    "authtoken accesstoken passwort kennwort psk".split()
)
_KEY_OF = frozenset(
    "api signing private secret access licence license encryption auth client account shared hmac master service "
    "deploy webhook subscription storage ssh crypto activation product serial admin app application".split()
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# What stands in place of a secret.
_STANDIN = re.compile(
    r"(?i)^(?:null|none|nil|undefined|true|false|string|str|text|bool|boolean|number|int|any|void|todo|tbd|fixme|n/?a|"
    r"empty|optional|required|default|redacted|removed|hidden|masked|secret|password|passwd|pwd|token|key|value|"
    r"placeholder|example|sample|dummy|fake|test|changeme|change[-_ ]?me|replace[-_ ]?me|set[-_ ]?me|fill[-_ ]?me|"
    r"(?:your|my|the|insert|enter|put|dummy|fake|example|sample|test|some|a|an)[-_ ](?:.*[-_ ])?"
    r"(?:key|secret|token|password|passwd|pwd|here|value|docs|credential|credentials)(?:[-_ ].*)?|"
    r".*[-_ ]here|dummy-.*|placeholder.*|xxx.*)$"
)
_REFERENCE = re.compile(
    r"(?i)^(?:\$|\{\{|\{%|%%|%\w+%$|<|\[|@|&|\\|!(?:vault|ref|sub|getatt|env)\b|#\{|vault:|arn:|file:|keyring:|env:|ssm:|sops:|"
    r"secret(?:s|sm|smanager)?:|op://|gcp:|aws:|azure:|kms:|ref[+:]|https?://|s3://|gs://|sha\d+[:-]|process\.|os\.|"
    r"config\.|settings\.|env\.|self\.|this\.|/run/|/etc/|/var/|\./|~/)"
)
_MASK = re.compile(r"[*•●…]{3,}|\.{3,}|x{6,}|X{4,}|#{4,}|_{5,}")


@cache
def names_credential(name: str) -> bool:
    """Whether an identifier ends in a word for a credential (``dbPassword``, ``API_KEY``; not ``compass``)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    if parts[-1] in _ONE:
        return parts[-1] != "auth" or len(parts) == 1 or parts[-2] in ("x", "http", "proxy")
    if len(parts) > 1 and (parts[-1] == "key" and parts[-2] in _KEY_OF or parts[-2:] in (["otp", "seed"], ["totp", "seed"], ["totp", "secret"], ["pass", "word"], ["pass", "phrase"])):
        return True
    return "".join(parts) in _ONE


def is_secret(value: str, least: int = 6, quoted: bool = True) -> bool:
    """Whether a value written after a credential's name is a usable secret."""
    v = value.strip()
    if len(v) < least or re.search(r"\s", v) or _REFERENCE.match(v) or _STANDIN.match(v) or _MASK.search(v):
        return False
    if "${" in v or "{{" in v or "%%" in v or re.fullmatch(r"[\d.,:+-]+", v):
        return False
    if len(set(v)) < 4:
        return False
    if not quoted and re.search(r"[()\[\]{}<>]", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[._/-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[A-Za-z]+(?:\.[A-Za-z]+)+", v) and len(v) < 24:
        return False
    if not quoted and re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)*", v) and len(v) < 16:
        return len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v)) >= 4  # letters of mixed case in no word's order
    return True


# ---------------------------------------------------------------- rules

_Q = r"(?P<q>[\"'`])(?P<s>(?:(?!(?P=q))[^\\\r\n]|\\.)+)(?P=q)"
_WORDS = (
    r"(?:passw(?:or)?d|passphrase|passcode|pwd|pass|_pw|secret|token|api[_-]?key|signing[_-]?key|private[_-]?key|"
    r"access[_-]?key|licen[cs]e[_-]?key|encryption[_-]?key|auth[_-]?key|client[_-]?key|account[_-]?key|shared[_-]?key|"
    r"hmac[_-]?key|master[_-]?key|service[_-]?key|deploy[_-]?key|credential|bearer|jwt|otpseed|otp_seed|x-auth|passwort|kennwort))"
)
_NAMED = r"(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]*?" + _WORDS[:-1] + r"[A-Za-z0-9_-]*)"


@dataclass(frozen=True)
class Rule:
    """One detection.  ``check`` names how the match of group ``s`` is judged."""

    name: str
    pattern: str
    check: str = "value"


# Shapes of issued tokens.
_ISSUED = (
    r"sk-(?:proj-|ant-)?[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}|"
    r"xox[abeoprs]-[0-9A-Za-z-]{16,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|[a-z]{2,8}_(?:live|prod|test)_[A-Za-z0-9]{16,}|"
    r"glx\.[a-z0-9]{6,12}\.[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}"
)

RULES = [
    Rule("assign_quoted", r"(?i)" + _NAMED + r"[\"'`]?\]?\s*(?::\s*[\w.<>|\[\] ]{1,40}?(?==)|)\s*(?::=|\?\?=|\|\|=|===?|!==?|=>|=|:)\s*(?:!!\w+\s+)?\(?\s*(?:[bBuU](?=[\"']))?" + _Q, "named"),
    Rule("assign_bare", r"(?i)" + _NAMED + r"[\"'`]?\]?\s*(?::=|=|:)\s*(?:!!\w+\s+)?(?P<s>[^\s\"'`,;&|]+)", "named_bare"),
    Rule("issued", r"(?<![A-Za-z0-9_])(?P<s>" + _ISSUED + r")(?![A-Za-z0-9_])", "mask"),
    Rule("uri_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`]*:(?P<s>[^\s/@\"'`]+)@[A-Za-z0-9\[]", "short"),
    Rule("auth_header", r"(?i)(?:bearer|basic|authorization:\s*token)\s+(?P<s>[A-Za-z0-9._~+/=-]{12,})", "value"),
    Rule("key_header", r"(?i)\bx-(?:[a-z]+-)*(?:key|token|auth|secret)[\"'`]?\s*[:=]\s*[\"'`]?(?P<s>[^\s\"'`,;}]+)", "value"),
    Rule("query_key", r"(?i)[?&](?:[a-z_]*(?:key|token|secret|passw(?:or)?d|pwd|sig|signature))=(?P<s>[^\s&\"'`#;]+)", "value"),
    Rule("param_key", r"(?i)params\s*=\s*\{[^}]*[\"'](?:[a-z_]*key|[a-z_]*token)[\"']\s*:\s*" + _Q, "value"),
    Rule("pass_flag", r"(?i)--(?:[a-z]+-)*(?:password|passwd|pass|token|secret|api-key)(?:=|\s+)[\"']?(?P<s>[^\s\"']+)", "value"),
    Rule("sshpass", r"(?i)sshpass\s+-p\s*[\"']?(?P<s>[^\s\"']+)", "short"),
    Rule("user_flag", r"(?i)(?:curl|wget|http)\b[^\n]*\s(?:-u|--user)\s*[\"']?[^\s\"':]+:(?P<s>[^\s\"']+)", "short"),
    Rule("mysql_flag", r"(?i)(?:mysql|mysqldump|psql)\b[^\n]*\s-p(?P<s>[^\s\"']{6,})", "short"),
    Rule("sudo_pipe", r"(?i)echo\s+" + _Q + r"\s*\|\s*sudo\s+-S", "short"),
    Rule("netrc", r"(?i)\blogin\s+\S+\s+password\s+(?P<s>[^\s\"'\\]+)", "short"),
    Rule("login_call", r"(?i)(?:login|authenticate|sign_?in|log_?in)\(\s*[\"'`][^\"'`]*[\"'`]\s*,\s*" + _Q, "short"),
    Rule("auth_pair", r"(?i)(?:auth|credentials?|creds?|login)\s*=\s*[\(\[]\s*[\"'`][^\"'`]*[\"'`]\s*,\s*" + _Q, "short"),
    Rule("fill_form", r"(?i)(?:fill|type|send_keys|setvalue)\(\s*[\"'`][^\"'`]*pass[^\"'`]*[\"'`]\s*,\s*" + _Q, "short"),
    Rule("compare_login", r"(?i)(?:user|login|name)\w*\s*={2,3}\s*[\"'`]\w+[\"'`]\s*(?:&&|and)\s*\w+\s*={2,3}\s*" + _Q, "short"),
    Rule("sql_password", r"(?i)(?:identified\s+by|password)\s+" + _Q, "short"),
    Rule("sql_insert", r"(?i)insert\s+into\s+[\w.\"`]+\s*\((?P<cols>[^)]*)\)\s*values\s*\((?P<vals>.*)\)", "columns"),
    Rule("login_note", r"(?i)\b(?:login|user|account|admin)\b\s*[:=]\s*\w+\s*/\s*(?P<s>\S+)", "short"),
    Rule("login_words", r"(?i)\b(?:get|log|sign) in (?:with|as|using)\s+[`\"']?\w+[`\"']?\s*/\s*[`\"']?(?P<s>[^\s`\"']+)", "short"),
    Rule("admin_row", r"(?i)\|\s*(?:admin|root|administrator)\s*\|\s*(?P<s>[^\s|]+)\s*\|", "short"),
    Rule("phrase_for", r"(?i)\b(?:passphrase|password|passcode|pass phrase)\b(?:\s+\w+){1,5}\s*(?:=|:|\bis\b)\s*[\"'`]?(?P<s>[^\s\"'`]+)", "value"),
    Rule("label_key", r"(?i)(?:api key|access key|secret key|signing key|auth token|access token|licen[cs]e key)\s*(?:\*\*)?\s*(?:=|:|\bis\b)\s*(?:\*\*)?\s*[\"'`]?(?P<s>[^\s\"'`]+)", "value"),
    Rule("old_key", r"(?i)\b(?:old|temp|temporary|current|new|prod|backup)\s+(?:key|token|secret|password|pwd)\s*[:=]?\s+(?P<s>[A-Za-z0-9+/=_.!@#$%^&*?-]{8,})", "value"),
    Rule("korean", r"(?:비밀\s?번호|암호|패스워드|접속\s?키|접속 토큰|토큰|비밀키|인증키)[은는이가]?\s*[:=：]?\s*[\"'`]?(?P<s>[^\s\"'`]+)", "short"),
    Rule("german", r"(?i)(?:passwort|kennwort|geheimnis)\s*(?:lautet|ist|[:=])\s*[\"'`]?(?P<s>[^\s\"'`]+)", "short"),
    Rule("hmac_call", r"(?i)hmac\.new\(\s*[bBuU]?" + _Q, "value"),
    Rule("create_hmac", r"(?i)createhmac\(\s*[\"'`][^\"'`]*[\"'`]\s*,\s*" + _Q, "value"),
    Rule("key_buffer", r"(?i)(?:buffer\.from|fromhex|unhexlify|b64decode)\(\s*" + _Q + r"[^\n]*(?://|#|--)[^\n]*\b(?:key|secret|token|password)\b", "value"),
    Rule("cookie", r"(?i)cookie\b[^\n]{0,20}?[=:,]\s*[\"'`]?\s*(?:sid|session|sessionid|auth|token|jwt|connect\.sid)=(?P<s>[^\s;\"'`]+)", "value"),
    Rule("client_call", r"(?i)\bclient\(\s*" + _Q, "long"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<s>)", "pem"),
]
_COMPILED = {r.name: re.compile(r.pattern) for r in RULES}
_BY_NAME = {r.name: r for r in RULES}
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_SHORT = re.compile(r"^\s*(?:(?:#+|//+|--+|;+|\*+|>+)\s+)*[\"'`]?(?P<b>[+/=]*[A-Za-z0-9][A-Za-z0-9+/=]*)[\"'`]?\s*[+,;.\\)]*\s*$")
_ESCAPED = re.compile(r"\\[rn]|(?P<s>(?:(?!\\[rn]).)+)")  # between line ends written as \n
_JOIN = re.compile(r"^\s*(?:[#/;*-]{1,3}\s*)?(?:\+|\.)?\s*(?P<q>[\"'`])(?P<s>(?:(?!(?P=q)).)*)(?P=q)")


def split_lines(content: str) -> list[str]:
    """Texts of the lines; the last one only when it isn't empty."""
    lines = re.split(r"\r\n|\r|\n", content)
    return lines[:-1] if lines and lines[-1] == "" else lines


def _continued(lines: list[str], i: int, end: int) -> list[tuple[int, int, int, str]]:
    """All pieces of a string literal that goes on after line ``i``: (line index, start, end, text)."""
    out = []
    at, rest = i + 1, lines[i][end:]
    while re.match(r"^\s*(?:\+|\\|\.)?\s*(?:(?://|#|--).*)?$", rest) and at < len(lines):
        joined = bool(re.match(r"^\s*(?:\+|\\|\.)", rest))
        m = _JOIN.match(lines[at])
        if not m or not joined and not (m.start("q") >= 0 and re.match(r"^\s*[\"'`]", lines[at])):
            break
        out.append((at, m.start("s"), m.end("s"), m["s"]))
        rest = lines[at][m.end() :]
        at += 1
    return out


def _key_parts(text: str) -> list[tuple[int, int]]:
    """Base64 in a line of a key's body, of whatever length where the line holds nothing else."""
    out = []
    for x in _ESCAPED.finditer(text):
        if x["s"] is None:
            continue
        runs = list(_BODY.finditer(x[0]))
        short = None if runs else _SHORT.match(x[0])
        out += [(x.start() + a, x.start() + b) for a, b in ([r.span() for r in runs] or ([short.span("b")] if short else []))]
    return out


def _key_body(lines: list[str], i: int, begin: re.Pattern[str], body: bool) -> tuple[int, bool, bool]:
    """The body after line ``i``: the line behind it, whether it is one, and whether that line has its END.

    It goes to the END line or the end of the file; another key or a line of another form ends it too.
    Without an END one short line after the last long one is its rest.
    """
    j, after = i + 1, i + 1
    while j < len(lines) and not begin.search(lines[j]):
        if _PEM_END.search(lines[j]):
            return j, body or bool(_BODY.search(lines[j][: _PEM_END.search(lines[j]).start()])), True
        if _BODY.search(lines[j]):
            body, after = True, j + 1
        elif body and len(lines[j].strip(" #/;*->\t")) > 0 and ":" not in lines[j] and not _key_parts(lines[j]):
            break
        j += 1
    return after + (i + 1 < after < len(lines) and bool(_key_parts(lines[after]))), body, False


def _columns(m: re.Match[str]) -> list[tuple[int, int]]:
    cols = [c.strip(" \"`[]") for c in m["cols"].split(",")]
    spans, base = [], m.start("vals")
    vals = list(re.finditer(r"'((?:[^']|'')*)'|[^,()\s][^,()]*", m["vals"]))
    for i, v in enumerate(vals):
        name = cols[i % len(cols)] if cols else ""
        if names_credential(name) and v[1] is not None and is_secret(v[1]):
            spans.append((base + v.start(1), base + v.end(1)))
    return spans


def secret_spans(lines: list[str], rules: list[str] | None = None, start: int = 0, stop: int | None = None) -> list[tuple[int, int, int, str]]:
    """(line index, start, end, rule) of every secret that begins in lines ``start`` to ``stop``; parts of one secret share its first line's order."""
    found: list[tuple[int, int, int, str, int]] = []
    gates = rule_gates()
    wanted = [(n, _COMPILED[n], _BY_NAME[n].check, gates[n]) for n in (rules if rules is not None else _COMPILED)]
    skip = -1
    for i in range(start, len(lines) if stop is None else min(stop, len(lines))):
        line = lines[i]
        if i <= skip or len(line) < 8:
            continue
        taken: list[tuple[int, int]] = []
        low = line.lower()
        for name, regex, check, gate in wanted:
            for g in gate:  # a match lies in one line, so the line has what its rule requires
                if g in low:
                    break
            else:
                continue
            if check == "pem":
                for m in regex.finditer(line):
                    tail = line[m.end() :]
                    closed = _PEM_END.search(tail)
                    if closed:
                        if _BODY.search(tail[: closed.start()]):
                            found.append((i, m.end(), m.end() + closed.start(), name, i))
                        continue
                    long = bool(_BODY.search(tail))
                    j, body, ended = _key_body(lines, i, regex, long)
                    if long:
                        found.append((i, m.end(), len(line), name, i))
                    elif body:  # the frame stays, the body goes
                        own = [] if tail[:1].isspace() else [(m.end() + x, m.end() + y) for x, y in _key_parts(tail)]
                        found.extend((i, x, y, name, i) for x, y in own or [(m.end(), m.end())])
                    if body and (ended or not long):
                        for k in range(i + 1, j + ended):
                            text = lines[k][: _PEM_END.search(lines[k]).start()] if k == j else lines[k]
                            found.extend((k, x, y, name, i) for x, y in _key_parts(text))
                        skip = j - 1
                continue
            for m in regex.finditer(line):
                if check == "columns":
                    spans = _columns(m)
                    found.extend((i, a, b, name, i) for a, b in spans)
                    taken += spans
                    continue
                a, b = m.span("s")
                value, parts = m["s"], []
                quoted = "q" in regex.groupindex
                if check == "named_bare":
                    value = value.rstrip(")}]>.")
                    b = a + len(value)
                if quoted and re.match(r"^\s*(?:\+|\\|\.)?\s*(?:(?://|#|--).*)?$", line[m.end() :]):
                    parts = _continued(lines, i, m.end())
                whole = value + "".join(p[3] for p in parts)
                ok = {
                    "named": lambda: names_credential(m["name"]) and is_secret(whole),
                    "named_bare": lambda: names_credential(m["name"]) and is_secret(value, 6, False),
                    "mask": lambda: not _MASK.search(value),
                    "short": lambda: is_secret(whole, 6) and bool(re.search(r"[\d\W]", whole) or len(whole) >= 10),
                    "long": lambda: is_secret(whole, 20) and bool(re.search(r"\d", whole)),
                    "value": lambda: is_secret(whole, 8, quoted) and bool(re.search(r"\d", whole) or len(whole) >= 20),
                }[check]()
                if ok and not any(a < y and x < b for x, y in taken):
                    taken.append((a, b))
                    found.append((i, a, b, name, i))
                    found.extend((k, x, y, name, i) for k, x, y, _ in parts)
    return [(k, a, b, f"{rule}@{first}") for k, a, b, rule, first in sorted(set(found))]


# ---------------------------------------------------------------- required trigrams

Query = tuple  # ("all",) | ("tri", text) | ("and", [...]) | ("or", [...])
_ALL: Query = ("all",)


def _both(op: str, items: list[Query]) -> Query:
    flat: list[Query] = []
    for x in items:
        if x == _ALL:
            if op == "or":
                return _ALL
            continue
        flat.extend(x[1] if x[0] == op else [x])
    unique = list(dict.fromkeys(map(repr, flat)))
    kept = [next(x for x in flat if repr(x) == r) for r in unique]
    return _ALL if not kept else kept[0] if len(kept) == 1 else (op, kept)


def _of_literal(text: str) -> Query:
    if len(text) == 2 and not text.isascii():
        return ("tri", text)  # two syllables of Hangul are as rare as three letters
    return _both("and", [("tri", text[k : k + 3]) for k in range(len(text) - 2)])


def _exact(node, limit: int = 16) -> list[str] | None:
    """All strings that a parsed piece can match when they are few; None otherwise."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        out = []
        for kind, v in arg:
            if kind is not sre.LITERAL:
                return None
            out.append(chr(v).lower())
        return sorted(set(out)) if len(set(out)) <= 6 else None
    if op is sre.SUBPATTERN:
        return _exact_seq(arg[-1], limit)
    if op is sre.BRANCH:
        out = []
        for branch in arg[1]:
            e = _exact_seq(branch, limit)
            if e is None:
                return None
            out += e
        return sorted(set(out)) if len(set(out)) <= limit else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and (arg[0], arg[1]) in ((0, 1), (1, 1)):
        e = _exact_seq(arg[2], limit)
        return None if e is None else e + ([""] if arg[0] == 0 else [])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return [""]
    return None


def _exact_seq(seq, limit: int = 16) -> list[str] | None:
    out = [""]
    for node in seq:
        e = _exact(node, limit)
        if e is None or len(out) * len(e) > limit:
            return None
        out = [a + b for a in out for b in e]
    return sorted(set(out))


def _walk(seq) -> Query:
    """Trigrams that any match of a parsed sequence must contain (over lower-cased text)."""
    need: list[Query] = []
    run = [""]

    def flush() -> None:
        nonlocal run
        if run != [""]:
            need.append(_both("or", [_of_literal(x) for x in run]))
        run = [""]

    for node in seq:
        e = _exact(node)
        if e is not None:
            if len(run) * len(e) > 32:
                flush()
            run = sorted({a + b for a in run for b in e})
            continue
        flush()
        op, arg = node
        if op is sre.SUBPATTERN:
            need.append(_walk(arg[-1]))
        elif op is sre.BRANCH:
            need.append(_both("or", [_walk(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            need.append(_walk(arg[2]))
    flush()
    return _both("and", need)


def required_trigrams(pattern: str) -> Query:
    """The boolean trigram query that every line matching ``pattern`` satisfies."""
    return _walk(sre_parser.parse(pattern))


def _leaves(q: Query) -> set[str]:
    return {q[1]} if q[0] == "tri" else set().union(*map(_leaves, q[1])) if len(q) > 1 else set()


def _holds(q: Query, have: frozenset[str]) -> bool:
    if q[0] == "all":
        return True
    if q[0] == "tri":
        return q[1] in have
    return (all if q[0] == "and" else any)(_holds(x, have) for x in q[1])


def _gate(q: Query) -> frozenset[str]:
    """Trigrams of which a text that satisfies the query has at least one (the empty one for any text): the fewest."""
    if q[0] == "all":
        return frozenset({""})
    if q[0] == "tri":
        return frozenset({q[1]})
    gates = [_gate(x) for x in q[1]]
    return min(gates, key=lambda g: ("" in g, len(g), sorted(g)[::-1])) if q[0] == "and" else frozenset().union(*gates)


@cache
def rule_gates() -> dict[str, tuple[str, ...]]:
    return {n: tuple(sorted(_gate(q))) for n, q in rule_queries().items()}


@cache
def rule_queries() -> dict[str, Query]:
    return {r.name: required_trigrams(r.pattern) for r in RULES}


@cache
def index_trigrams() -> tuple[str, ...]:
    """All trigrams that some rule requires; the index keeps postings of these only."""
    return tuple(sorted(set().union(*(_leaves(q) for q in rule_queries().values()))))


@cache
def _gram_table() -> tuple[list[str], np.ndarray, list[str]]:
    """ASCII grams, a table from three bytes to their places (from 1), and the other grams."""
    grams = [g for g in index_trigrams() if g.isascii()]
    table = np.zeros(1 << 24, dtype=np.uint16)
    for i, g in enumerate(grams, 1):
        table[int.from_bytes(g.encode(), "big")] = i
    return grams, table, [g for g in index_trigrams() if not g.isascii()]


def trigrams_of(low: str) -> list[str]:
    """The index' trigrams that a lower-cased text has."""
    grams, table, others = _gram_table()
    b = np.frombuffer(low.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return []
    at = table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
    found = [grams[i - 1] for i in np.unique(at[at > 0]).tolist()]
    return found if low.isascii() else found + [g for g in others if g in low]


# ---------------------------------------------------------------- operators


def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, content`` of the last delivery of each artifact."""
    order = F.struct(F.col("indexed_at").alias("t"), F.xxhash64("content").alias("h")) if "indexed_at" in artifacts.columns else F.xxhash64("content")
    return artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(F.max_by("content", order).alias("content"))


def chunk_files(artifacts: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``artifact_id, chunk, first_line, lines``: whole lines, each chunk with its position."""
    lines = F.split(F.col("content"), "\r\n|\r|\n")
    numbered = artifacts.where("content is not null and content <> ''").select("artifact_id", lines.alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(chunk_lines))
    return numbered.select("artifact_id", "all", F.posexplode(starts).alias("chunk", "start")).select(
        "artifact_id", "chunk", (F.col("start") + 1).alias("first_line"), F.slice("all", F.col("start") + 1, chunk_lines).alias("lines")
    )


def build_trigram_index(chunks: DataFrame) -> DataFrame:
    """Postings ``trigram, artifact_id, chunk`` of the required trigrams (lower-cased text)."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nos, tris = [], [], []
            for a, c, lines in zip(pdf["artifact_id"], pdf["chunk"], pdf["lines"]):
                hit = trigrams_of("\n".join(lines).lower())
                ids += [a] * len(hit)
                nos += [c] * len(hit)
                tris += hit
            if ids:
                yield pd.DataFrame({"trigram": tris, "artifact_id": ids, "chunk": nos})

    return chunks.select("artifact_id", "chunk", "lines").mapInPandas(post, "trigram string, artifact_id string, chunk int")


def candidates(postings: DataFrame) -> DataFrame:
    """``artifact_id, chunk, rules``: chunks whose postings satisfy the query of some rule."""
    queries = rule_queries()

    @F.pandas_udf("array<string>")
    def satisfied(have: pd.Series) -> pd.Series:
        memo: dict[frozenset[str], list[str]] = {}
        out = []
        for h in have:
            key = frozenset(h)
            if key not in memo:
                memo[key] = [n for n, q in queries.items() if _holds(q, key)]
            out.append(memo[key])
        return pd.Series(out)

    per_chunk = postings.groupBy("artifact_id", "chunk").agg(F.collect_set("trigram").alias("have"))
    return per_chunk.select("artifact_id", "chunk", satisfied("have").alias("rules")).where("size(rules) > 0")


Postings = dict[str, set[tuple[int, int]]]


def post(contents: Iterable[str | None]) -> Postings:
    """Postings of a batch of files: for each required trigram the (file, chunk) places that have it."""
    postings: Postings = {}
    for i, content in enumerate(contents):
        lines = split_lines(content or "")
        for c in range(0, len(lines), CHUNK_LINES):
            for g in trigrams_of("\n".join(lines[c : c + CHUNK_LINES]).lower()):
                postings.setdefault(g, set()).add((i, c // CHUNK_LINES))
    return postings


def intersect(q: Query, postings: Postings) -> set[tuple[int, int]]:
    """Places whose postings satisfy a query; the shortest postings are intersected first."""
    if q[0] == "tri":
        return postings.get(q[1], set())
    if q[0] == "all":
        return set().union(*postings.values())
    parts = [intersect(x, postings) for x in q[1]]
    return set.intersection(*sorted(parts, key=len)) if q[0] == "and" else set().union(*parts)


def batch_candidates(contents: Iterable[str | None]) -> dict[int, list[dict]]:
    """Per file of a batch its candidate chunks with their rules, in the rules' order."""
    postings = post(contents)
    at: dict[int, dict[int, list[str]]] = {}
    for name, q in rule_queries().items():
        for i, c in intersect(q, postings):
            at.setdefault(i, {}).setdefault(c, []).append(name)
    return {i: [{"chunk": c, "rules": r} for c, r in sorted(own.items())] for i, own in at.items()}


def _verified(artifacts: DataFrame, schema: str, emit) -> DataFrame:
    """Index, intersect and verify each batch of files where it lies: only the last deliveries are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = batch_candidates(pdf["content"])
            out = emit(pdf.assign(at=[at.get(i) for i in range(len(pdf))]))
            if len(out):
                yield out

    return current_artifacts(artifacts).mapInPandas(run, schema)


def _spans_of(content: str, at) -> list[tuple[int, int, int, str]]:
    lines = split_lines(content)
    out: list[tuple[int, int, int, str]] = []
    covered: set[tuple[int, int]] = set()
    for x in sorted(at, key=lambda r: r["chunk"]):
        start = int(x["chunk"]) * CHUNK_LINES
        # a secret may begin in the chunk's last line and go on: all following lines are at hand
        for k, a, b, tag in secret_spans(lines, list(x["rules"]), start, start + CHUNK_LINES):
            if (k, a) not in covered:
                covered.add((k, a))
                out.append((k, a, b, tag))
    return out


def find_credentials(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, line, rule``: one row for each line on which a credential begins (rule: the first that tells)."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: dict[tuple[str, int], str] = {}
        for i, content, at in zip(pdf["artifact_id"], pdf["content"], pdf["at"]):
            for _, _, _, tag in _spans_of(content, at) if at else ():
                rule, _, first = tag.rpartition("@")
                rows.setdefault((i, int(first) + 1), rule)
        return pd.DataFrame({"artifact_id": [k[0] for k in rows], "line": [k[1] for k in rows], "rule": list(rows.values())}).astype({"line": "int32"})

    return _verified(artifacts, "artifact_id string, line int, rule string", emit)


def mask_text(content: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with each secret's characters replaced by ``*``: equal length, equal line ends."""
    pieces = re.split(r"(\r\n|\r|\n)", content)
    by_line: dict[int, list[tuple[int, int]]] = {}
    for k, a, b, _ in spans:
        by_line.setdefault(k, []).append((a, b))
    for k, own in by_line.items():
        line = pieces[2 * k]
        for a, b in own:
            line = line[:a] + "*" * (b - a) + line[b:]
        pieces[2 * k] = line
    return "".join(pieces)


def redact(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, content, n_secrets``: every file, with only the secret values masked."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, counts = [], []
        for content, at in zip(pdf["content"], pdf["at"]):
            spans = _spans_of(content, at) if at and content else []
            texts.append(mask_text(content, spans) if spans else content)
            counts.append(len({s[3] for s in spans}))
        return pd.DataFrame({"artifact_id": pdf["artifact_id"], "content": texts, "n_secrets": counts})

    return _verified(artifacts, "artifact_id string, content string, n_secrets long", emit)
