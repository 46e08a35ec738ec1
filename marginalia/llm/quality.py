"""Per-document text statistics, and from them the type of text: prose, list, table or junk.

Statistics are exact numbers of each text.  Thresholds on statistics of its lines are *labelling
functions*: each looks at one thing (how a line ends, its function words, a marker, columns, figures,
symbols, ...), is sometimes wrong, and speaks for one type or stays silent.  How often each fires
under each type is learned without labels by expectation-maximization on their agreements, over the
counts of firing patterns of the whole corpus (17 functions, so at most 2^17 patterns whatever the
corpus' size; a text weighs the same however long it is).  A line's types are the posterior of its
pattern, and a document's type is the one with the largest posterior share of its characters.

Defined results: null and empty texts, and texts of invisible characters only, fire ``nothing`` with
zero statistics and are junk; ties go to the first of ``KINDS``; extra columns are ignored; texts are
read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import cut

KINDS = ("prose", "list", "table", "junk")

# Frequent function words of the corpus' languages.
COMMON = frozenset(
    "the a an of to in on at is are was were be been has have had that this it its and or but for with by from as not "
    "no which who what when where how if than then so because since before after only one some most each would could "
    "should will can did does they we you i he she her our my their there it's only about nobody "
    "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war wird wurde hat "
    "dass weil wenn als mit von zu zum zur im in am an auf aus für uns es muss man noch warum niemand".split()
)
_MARK = re.compile(r"^(?:[-*+•·–—▪◦‣o]\s+|\(?\d{1,4}(?:[.):]|\s+-)\s+|\[[ xX✓]?\]\s*|\(?[A-Za-z]\)\s|#{1,6}\s+\S|☐|☑)")
_ENUM = re.compile(r"(?:^|\s)\(?[a-z0-9]{1,2}[).]\s+\S")
_PATH = re.compile(r"^(?:[\w.~-]*/)+[\w.-]+$|^[A-Za-z]:\\\S+$")
_SUFFIX = re.compile(r"\.\w{1,5}$")
_SETTING = re.compile(r"^[\w.\- ]{1,40}?\s*[:=]\s*\S+(?:\s+\S+){0,2}$")
_HEADED = re.compile(r"^\S+(?: \S+)? [—–-] \S")
_TOC = re.compile(r"(?:\.{4,}|…{2,}|\s·\s·)\s*\d+$")
_GAP = re.compile(r"\S(?: {2,})(?=\S)")
_PAIR = re.compile(r"(?:^|\s)[^\s=]{1,30}=\S")
_NUMBER = re.compile(r"(?<!\S)(?=[^\s\d]*+\d)[-+$€£%]?[\d.,:%/-]++(?!\S)")
_TAG = re.compile(r"<[^<>]{1,300}>|&[a-z]{2,8};|&#\d+;")
_HEX = re.compile(r"^[0-9a-f]{8}\s+(?:[0-9a-f]{2}\s+){4,}", re.I)
_SENTENCE_END = tuple(".?!。？！…")
_CLOSE = "\"'”’」』)]*_`"
_GOOD = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]+")
_ORDINARY = ".,;:?!'\"()-–—’“”…"
_LATIN1 = re.compile("[\x80-¦¨-¯±-¶¸-ÃÅ-Õ×-ÛÝÞà-ãå-õ÷-ûý-ÿ\ufffdŒœ€™]+")
_DROP = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x00AD, 0xA0], None)
_FOREIGN = re.compile(r"[~^][^\s]|[^\s][~^]|[\\{}<>][^\s\w/]")
_MARKED = frozenset("-*+#[(0123456789•·–—▪◦‣☐☑abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HANGUL = re.compile(r"[가-힣]")
_SPLIT = re.compile(r"\s[·/•]\s")
_COMMA = re.compile(r"[,;、]\s?")


@cache
def _class(ch: str) -> str:
    """L(etter), D(igit), ordinary punctuation, or S(ymbol)."""
    return "L" if ch.isalpha() else "D" if ch.isdigit() else "." if ch in _ORDINARY or ch == "_" else "S"


_WORDISH = re.compile(r"(?<!\S)[\"'“‘(\[*`]*+(?:[^\W\d_]++(?:['’.-][^\W\d_]++)*+|[\d.,%$:]++)[\"'”’)\].,;:?!*`…]*+(?!\S)")
_RUN = re.compile(r"(.{1,3}?)\1{11,}")

STATISTICS = (
    "n_chars n_lines n_words mean_word_length words_per_line letter_ratio digit_ratio symbol_ratio end_punct_share "
    "common_word_share marker_share short_share field_share unique_line_share repetition compress_ratio odd_char_share "
    "tag_share scrambled_share"
).split()
SCHEMA = "doc_id long, " + ", ".join(f"{s} {'long' if s.startswith('n_') else 'double'}" for s in STATISTICS) + ", lines array<struct<pattern:int,weight:int>>"
#: What a function starts from, and how much its silence says.
START, SILENCE = 0.85, 0.4
#: Texts that back a function's starting beliefs at least.
BACKING = 10
#: What the lines of one text weigh together.
TEXT_WEIGHT = 1_000_000
# An article is followed by none of the words of the second list.
_ARTICLES = frozenset("the a an".split())
_NO_NOUN = frozenset("the a an of to in on at is are was were be been has have had and or but for with by from as that which who if than".split())
# Last syllables of Korean particles and verb endings.
_ENDINGS = frozenset("은는이가을를에의로도와과서고다지만면까")
_DIGIT = re.compile(r"\d")
_AFTER_LETTER = frozenset((")", " "))
_EDGE = ".,;:?!\"'()[]*`“”‘’…"
_PLAIN = re.compile(r"[\w .,:?!'\"()/‘’“”…–—%$-]*")


#: Name, the type it is expected to speak for; bit i of a pattern is function i.
FUNCTIONS = [
    ("ended", "prose"), ("function_words", "prose"), ("many_words", "prose"),
    ("marker", "list"), ("few_words", "list"), ("entry_form", "list"), ("pieces", "list"), ("bare_words", "list"),
    ("delimited", "table"), ("columns", "table"), ("figures", "table"),
    ("symbols", "junk"), ("no_words", "junk"), ("odd_chars", "junk"), ("repetition", "junk"), ("scrambled", "junk"), ("nothing", "junk"),
]
_BIT = {name: 1 << i for i, (name, _) in enumerate(FUNCTIONS)}


def _fields(s: str) -> tuple[int, str]:
    """The most frequent field separator of a line, with its count."""
    return max((s.count(d), d) for d in "|│\t;,=")


def line_pattern(s: str, words: list[str], ended: bool) -> int:
    """Which functions fire on one line without outer blanks."""
    out = 0
    mark = (s[1:2] in _AFTER_LETTER if s[0].isalpha() else s[0] in _MARKED) and _MARK.match(s)
    if mark:
        out |= _BIT["marker"]
        words = s[mark.end() :].split() or words
    n, nw = len(s), len(words)
    ascii_only = s.isascii()
    hangul = not ascii_only and bool(_HANGUL.search(s))
    common = sum(map(COMMON.__contains__, s.lower().split()))
    if hangul:
        common += sum(w[-1] in _ENDINGS for w in (x.strip(_EDGE) for x in words) if w) * 0.4
    tidy = "  " not in s and "...." not in s and _PLAIN.fullmatch(s)
    if tidy and ended and not mark and nw >= 4 and common >= max(0.8, 0.12 * nw) and s.count(", ") == s.count(",") and not _ENUM.search(s):
        # nothing below fires on such a line
        return _BIT["ended"] | _BIT["function_words"] | (_BIT["many_words"] if nw >= 10 else 0)
    if ended and nw >= (3 if hangul else 4):
        out |= _BIT["ended"]
    longest = max(map(len, words))
    path = (longest <= 45 or _SUFFIX.search(s)) and _PATH.match(s)
    figures = len(_NUMBER.findall(s)) if _DIGIT.search(s) else 0
    if tidy:
        if not ended and (path or nw <= 5 and (_SETTING.match(s) or s[-1] == ":") or nw <= 9 and s[-1] == ":" or _HEADED.match(s) and nw <= 9 and common <= 2):
            out |= _BIT["entry_form"]
    else:
        if _TOC.search(s) or path or not ended and (_SETTING.match(s) and nw <= 5 and s.count("=") < 2 or _HEADED.match(s) and nw <= 9 and common <= 2):
            out |= _BIT["entry_form"]
        bars = s.count("|") + s.count("│")
        if bars >= 2 or "\t" in s or s[0] in "┌└├╔╚╠+" and n > 3 and not _GOOD.search(s):
            out |= _BIT["delimited"]
        gaps = len(_GAP.findall(s)) if "  " in s else 0
        if gaps >= 2 and nw <= 4 * (gaps + 1) and not ended and not out & _BIT["entry_form"] or s.count("=") >= 2 and not ("<" in s and ">" in s) and len(_PAIR.findall(s)) >= max(2, 0.4 * nw):
            out |= _BIT["columns"]
        dense = n - s.count(" ")
        letters = len(_GOOD.findall(s))
        ruled = out & (_BIT["delimited"] | _BIT["entry_form"])
        if dense >= 8 and letters < 0.5 * dense and not ruled and figures < 0.5 * nw or len(_FOREIGN.findall(s)) >= max(3, 0.015 * n) or _HEX.match(s):
            out |= _BIT["symbols"]
        if len(_LATIN1.findall(s)) > 0.12 * n:
            out |= _BIT["odd_chars"]
    noise = out & (_BIT["symbols"] | _BIT["odd_chars"])
    if noise:  # signs all over the line part nothing
        out &= ~(_BIT["delimited"] | _BIT["columns"])
    for d in ",;":
        k = s.count(d)
        if not noise and k >= 2 and k > 2 * (s.count(d + " ") + s.count(d + "\t")) and max(map(len, s.split(d))) <= 60:
            out |= _BIT["delimited"]
    if nw >= 3 and figures >= 0.6 * nw or figures >= 2 and figures >= 0.4 * nw:
        out |= _BIT["figures"]
    enum = len(_ENUM.findall(s))
    if enum >= 3 and nw <= 9 * enum:
        out |= _BIT["pieces"]
    elif not ended:
        split = [x for x in _SPLIT.split(s) if x.strip()]
        pieces = [x for x in _COMMA.split(s) if x.strip()] if s.count(",") + s.count(";") + s.count("、") >= 2 else []
        if not out & _BIT["delimited"] and (len(split) >= 3 and nw <= 6 * len(split) or len(pieces) >= 3 and nw <= 6 * len(pieces)):
            out |= _BIT["pieces"]
    # a line cut into fields says nothing by its number of words or by function words inside of a field
    whole = not out & (_BIT["delimited"] | _BIT["columns"] | _BIT["pieces"] | _BIT["entry_form"])
    if whole and nw >= 4 and common >= max(0.8, 0.12 * nw):
        out |= _BIT["function_words"]
    elif nw >= 2 and common < 1 and not ended and whole and not figures:
        out |= _BIT["bare_words"]
    if nw >= 10 and whole:
        out |= _BIT["many_words"]
    elif nw <= 6 and not ended and whole and longest <= 45:
        out |= _BIT["few_words"]
    parted = out & (_BIT["delimited"] | _BIT["columns"])
    if not parted and (longest > 45 and longest > 0.6 * n and not path and "://" not in s or nw >= 4 and not hangul and not mark and not (ended and tidy) and nw - len(_WORDISH.findall(s)) > 0.45 * nw):
        out |= _BIT["no_words"]
    return out


def scrambled_share(tokens: list[str]) -> float:
    """Share of the articles that a word follows which no article goes before, of three articles or more."""
    after = [b for a, b in zip(tokens, tokens[1:]) if a in _ARTICLES]
    return sum(map(_NO_NOUN.__contains__, after)) / len(after) if len(after) >= 3 else 0.0


def statistics(text: str | None) -> tuple[list[float], dict[int, int]]:
    """The statistics in the order of ``STATISTICS``, and what its lines weigh by pattern of functions that fire."""
    text = text or ""
    v = dict.fromkeys(STATISTICS, 0.0)
    v["n_chars"] = len(text)
    lines = [s for s in map(str.strip, text.split("\n")) if s and (len(s) > 8 or s.isascii() or s.translate(_DROP).strip())]
    if not lines:
        return [v[x] for x in STATISTICS], {_BIT["nothing"]: TEXT_WEIGHT}
    visible = "".join(text.split())
    quoted = sum(s[:1] == ">" for s in lines) >= 0.5 * len(lines)
    bodies = [s.lstrip("> ") or s for s in lines] if quoted else lines
    size: dict[int, int] = {}
    n_words = ends = marks = short = 0
    fields: dict[tuple[str, int], int] = {}
    memo: dict[str, tuple[int, int, bool, tuple[int, str]]] = {}
    parts = _BIT["delimited"] | _BIT["columns"]
    for s in bodies:
        known = memo.get(s)
        if known is None:
            words = s.split()
            last = s[-1]
            ended = last in _SENTENCE_END or last in _CLOSE and s.rstrip(_CLOSE).endswith(_SENTENCE_END)
            pattern = line_pattern(s, words, ended)
            known = memo[s] = (pattern, len(words), ended, _fields(s) if pattern & parts else (0, ""))
        pattern, nw, ended, best = known
        size[pattern] = size.get(pattern, 0) + len(s)
        n_words += nw
        ends += ended
        short += nw <= 6
        marks += pattern & _BIT["marker"] > 0
        if best[0] >= 2:
            fields[best[1], best[0]] = fields.get((best[1], best[0]), 0) + 1
    n, seen = len(bodies), len(visible)
    tokens = text.lower().split()
    of = dict.fromkeys("LDSO.", 0)
    odd = 0
    for ch, k in Counter(visible).items():
        of[_class(ch)] += k
        odd += k if ch > "\x7f" and _LATIN1.match(ch) else 0
    letters, digits, odd = of["L"], of["D"], odd / seen
    data = text.encode("utf-8", "replace")
    unique = len(memo) / n
    tags = sum(map(len, _TAG.findall(text))) if "<" in text and ">" in text else 0
    ratio = len(data) / len(zlib.compress(data, 1))
    few = len(tokens) >= 24 and letters == seen and len(set(tokens)) <= 3 + 0.1 * min(len(tokens), 100)
    runs = sum(len(m[0]) for m in _RUN.finditer(text)) if ratio > 5 else 0
    again = bool(n >= 4 and unique <= 0.34 or few or runs > 0.5 * len(text) or len(text) >= 150 and ratio > 9 + len(text) / 1500)
    scrambled = scrambled_share(tokens)
    v |= {
        "n_lines": n, "n_words": n_words, "mean_word_length": seen / n_words, "words_per_line": n_words / n,
        "letter_ratio": letters / seen, "digit_ratio": digits / seen, "symbol_ratio": of["S"] / seen,
        "end_punct_share": ends / n, "common_word_share": sum(map(COMMON.__contains__, tokens)) / len(tokens),
        "marker_share": marks / n, "short_share": short / n, "field_share": max(fields.values(), default=0) / n, "unique_line_share": unique,
        "repetition": float(again), "compress_ratio": ratio, "odd_char_share": odd, "tag_share": tags / len(text), "scrambled_share": scrambled,
    }
    # functions of the whole text fire on each of its lines
    bare = tags > 0.3 * len(text) and len(_LETTER.findall(_TAG.sub("", text))) < 0.5 * tags
    whole = (
        _BIT["repetition"] * again | _BIT["symbols"] * bool(bare or letters + digits < 0.3 * seen and not fields) | _BIT["odd_chars"] * (odd > 0.15)
        | _BIT["scrambled"] * (scrambled > 0.1) | _BIT["nothing"] * (letters + digits == 0)
    )
    total = sum(size.values())
    weights: dict[int, int] = {}
    # what goes on and on says it once, and words out of order say nothing by their kind or number
    by_words = _BIT["ended"] | _BIT["function_words"] | _BIT["many_words"] | _BIT["few_words"] | _BIT["bare_words"]
    silent = -1 if again else by_words if whole & (_BIT["scrambled"] | _BIT["odd_chars"]) else 0
    for pattern, k in size.items():
        pattern &= ~silent
        weights[pattern | whole] = weights.get(pattern | whole, 0) + round(TEXT_WEIGHT * k / total)
    return [v[x] for x in STATISTICS], weights


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics for each row of ``documents`` (``doc_id, text``), with its lines' weights by pattern."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [statistics(t) for t in pdf["text"]]
            out = pd.DataFrame([g[0] for g in got], columns=list(STATISTICS))
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out["lines"] = [[{"pattern": p, "weight": w} for p, w in sorted(g[1].items())] for g in got]
            yield out.astype({s: "int64" for s in STATISTICS if s.startswith("n_")})

    return rows.mapInPandas(run, SCHEMA)


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, anchor: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of labelling functions that may stay silent: ``(prior[k], fires[j, k], posterior[p, k])``.

    ``counts`` are in units of ``TEXT_WEIGHT``.  ``fires`` is how often a function fires under each type.  Functions are silent together (a line cut into
    fields leaves few to speak), so silence counts with the power ``SILENCE`` of its likelihood.  ``anchor`` is
    the share of the corpus' size (at least ``BACKING`` texts) that backs the starting beliefs (a function speaks
    for its own type), which keeps the classes from trading names.  What is learned stands as learned: a function may turn out to
    speak for another type.
    """
    j, k = len(FUNCTIONS), len(KINDS)
    fired = ((patterns[:, None] >> np.arange(j)) & 1).astype(float)
    own = np.array([KINDS.index(c) for _, c in FUNCTIONS])
    belief = np.where(own[:, None] == np.arange(k), START, (1 - START) / (k - 1))
    weight = counts / counts.sum()
    anchor = max(anchor, BACKING * TEXT_WEIGHT / counts.sum())
    prior, fires = np.full(k, 1 / k), belief
    post = np.zeros((len(patterns), k))
    for turn in range(rounds):
        logp = np.log(prior) + fired @ np.log(fires)
        if turn:  # nothing is known of silence yet
            logp += SILENCE * ((1 - fired) @ np.log(1 - fires))
        post = np.exp(logp - logp.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * weight[:, None]
        size = mass.sum(0)
        new = np.clip((fired.T @ mass + anchor * belief) / (size + anchor), 1e-4, 1 - 1e-4)
        step = np.abs(new - fires).max()
        prior, fires = (size + anchor) / (1 + k * anchor), new
        if step < 1e-6:
            break
    return prior, fires, post


def _learned(stats: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(patterns, counts, fires, posterior)`` of all lines."""
    each = stats.select(F.explode("lines").alias("x")).groupBy("x.pattern").agg(F.sum("x.weight").alias("n"))
    seen = sorted((r["pattern"], r["n"]) for r in each.collect())  # at most 2^17 rows
    patterns, counts = np.array([p for p, _ in seen], dtype=np.int64), np.array([n for _, n in seen], dtype=float)
    if not seen:
        return patterns, counts, np.zeros((len(FUNCTIONS), len(KINDS))), np.zeros((0, len(KINDS)))
    _, fires, post = learn(patterns, counts)
    return patterns, counts, fires, post


def text_types(documents: DataFrame) -> DataFrame:
    """Statistics plus ``kind`` and the posterior shares ``p_prose .. p_junk`` for each document."""
    stats = cut(text_statistics(documents))
    patterns, _, _, post = _learned(stats)
    shared = documents.sparkSession.sparkContext.broadcast((patterns, post))  # at most 2^17 patterns
    names = [f"p_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, posterior = shared.value
        for b in batches:
            lines = b.column("lines")
            at = np.repeat(np.arange(b.num_rows), np.diff(lines.offsets.to_numpy()))
            flat = lines.flatten()
            pattern, weight = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            share = np.zeros((b.num_rows, len(KINDS)))
            for k in range(len(KINDS)):
                share[:, k] = np.bincount(at, weight * posterior[np.searchsorted(known, pattern), k], b.num_rows)
            share /= share.sum(1, keepdims=True)
            kind = pa.array([KINDS[i] for i in np.round(share, 9).argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(s) for s in ("doc_id", *STATISTICS)), kind, *map(pa.array, share.T)], names=["doc_id", *STATISTICS, "kind", *names])

    schema = SCHEMA[: SCHEMA.rindex(", lines")] + ", kind string, " + ", ".join(f"{n} double" for n in names)
    return stats.mapInArrow(run, schema)


def labelling_functions(documents: DataFrame) -> DataFrame:
    """What EM learned: ``name, speaks_for, fired, p_prose .. p_junk``: the share of texts' lines on which each fires, and how often under each type."""
    patterns, counts, fires, _ = _learned(text_statistics(documents))
    total = counts.sum() or 1.0
    rows = [(n, c, float(counts[(patterns >> i) & 1 == 1].sum() / total), *map(float, fires[i])) for i, (n, c) in enumerate(FUNCTIONS)]
    return documents.sparkSession.createDataFrame(rows, "name string, speaks_for string, fired double, " + ", ".join(f"p_{k} double" for k in KINDS))
