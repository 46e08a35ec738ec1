"""Text measures as Column expressions.

Lengths are in UTF-16 units and white space is the ECMAScript set, which neither Java's ``\\s`` nor
SQL's functions use, so both are spelled out here once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ECMAScript white space and line terminators (members of a character class).
WS_JAVA = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed value: code units that count as one token each.
CJK_JAVA = r"\x{3040}-\x{30FF}\x{3131}-\x{D7A3}"
PROFILE = "heuristic-v1"

_WS_RUN = re.compile(f"[^{WS}]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3131-\ud7a3]")


def utf16_units(c: Column) -> Column:
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def cjk_units(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{CJK_JAVA}]+", ""))


def word_count(c: Column) -> Column:
    """Runs of characters that aren't white space, by the gaps between them (a text has fewer gaps than words' characters)."""
    ws = f"[{WS_JAVA}]"
    edge = lambda at: F.substring(c, at, 1).rlike(ws).cast("int")
    return F.when(c == "", 0).otherwise(F.size(F.split(c, ws + "+")) - edge(1) - edge(-1))


def tokens_of(units: Column, cjk: Column, words: Column) -> Column:
    """Estimated tokens of a text with these (additive) measures; null for a null text."""
    return F.when(units == 0, F.lit(0)).when(units.isNotNull(), F.greatest(F.lit(1), words, F.ceil((units - cjk) / 4.0).cast("int") + cjk)).cast("int")


def estimate_tokens(c: Column) -> Column:
    """Estimated tokens of a text; its measures are bound once, so that no branch scans the text again."""
    m = F.array(F.struct(utf16_units(c).alias("u"), cjk_units(c).alias("k"), word_count(c).alias("w")))
    return F.get(F.transform(m, lambda x: tokens_of(x["u"], x["k"], x["w"])), F.lit(0))


# Spellings of the languages of texts.
LANGUAGES = {"en": ("en", "eng"), "ko": ("ko", "kor"), "de": ("de", "ger", "deu")}


def language_code(c: Column) -> Column:
    """The language's code whatever its spelling; ``other`` for a missing or unknown one."""
    out = F.lit("other")
    for code, spellings in LANGUAGES.items():
        out = F.when(F.lower(F.trim(c)).isin(*spellings), code).otherwise(out)
    return out


def plain_label(c: Column) -> Column:
    """A label without differences of case, blanks, hyphens and trailing stops."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[.\s]+\z", ""), r"[\s_-]+", "_")


def fits_budget(estimate: Column, budget: Column) -> Column:
    """A missing budget fits everything."""
    return F.coalesce(estimate <= budget, F.lit(True))


def measures(text: str) -> tuple[int, int, int]:
    """(UTF-16 units, CJK units, words) of a Python string."""
    units = len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2
    return units, 0 if text.isascii() else len(_CJK.findall(text)), len(_WS_RUN.findall(text))


def tokens_from(units: int, cjk: int, words: int) -> int:
    return 0 if units == 0 else max(1, words, math.ceil((units - cjk) / 4) + cjk)


def estimate(text: str) -> int:
    return tokens_from(*measures(text))
