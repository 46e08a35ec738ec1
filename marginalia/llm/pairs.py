"""Defects of prompt and response pairs.

``classify_pair`` labels one (question, gold, answer) triple; ``flag_defects`` runs it over a
DataFrame in Arrow batches.  Four devices, one for each way in which a pair breaks:

* a *suffix automaton* of the prompt measures how much of the response is copied from it;
* an *Aho-Corasick automaton* of refusal phrases finds responses that decline;
* a *delimiter stack* finds quotes, brackets and code spans that are opened and never closed;
* *script counts*, then *stopword votes*, decide in which language prompt and response are worded.

Defined results: a null or blank question never makes a pair ``copied_question`` or
``other_language``; a null or empty ``gold`` leaves truncation to the text's own form; repeated
deliveries of a turn give one row; texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that stand for "no answer" once case and punctuation are removed.
NOTHING = {
    "", "null", "none", "nil", "na", "n a", "nan", "undefined", "empty", "blank", "tbd", "todo",
    "no answer", "answer", "response", "reply", "output", "assistant", "result", "no response",
    "답변", "답", "응답", "없음", "해당 없음", "정답", "antwort", "keine antwort", "keine", "leer",
}

# Clauses by which a writer declines.  Lower case, straight apostrophes.
REFUSALS = [
    "i can't help", "i cannot help", "i can not help", "i can't share", "i cannot share",
    "i can't provide", "i cannot provide", "i can't assist", "i cannot assist", "i can't answer",
    "i cannot answer", "i can't discuss", "i cannot discuss", "i can't disclose", "i cannot disclose",
    "i can't comply", "i cannot comply", "i can't do that", "i cannot do that", "i can't fulfill",
    "i cannot fulfill", "i can't process", "i cannot process", "i can't respond", "i cannot respond",
    "i can't give", "i cannot give", "i can't reveal", "i cannot reveal", "i can't support", "i can't engage",
    "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "i won't be able to",
    "i will not be able to", "i must leave", "i must decline", "i have to decline", "i need to decline",
    "i decline to", "i respectfully decline", "i will not be answering", "i won't be answering",
    "i will not answer", "i won't answer", "i refuse to", "i'd rather not", "i would rather not answer",
    "i prefer not to", "i'd prefer not to", "pass on this one", "i have been told to", "not something i do",
    "talk about something else", "move on to another topic", "discuss something else", "change the subject",
    "no comment", "would not be right", "wouldn't be right", "against the rules", "against my", "stay private with me",
    "i don't answer", "i do not answer", "ask a human", "leave it there", "such requests are", "i don't think i should", "i do not think i should", "i shouldn't answer",
    "i should not answer", "i'm not allowed", "i am not allowed", "what i'm allowed to", "what i am allowed to",
    "i'm not permitted", "i am not permitted", "outside what i do", "outside of what i do",
    "outside of what i", "beyond what i can", "not be appropriate for me", "not appropriate for me",
    "not comfortable", "against my guidelines", "my guidelines", "my policy", "not something i can",
    "something i cannot", "something i can't", "i'm afraid i can't", "i am afraid i cannot",
    "unable to assist", "unable to help with", "cannot assist with", "can't assist with", "must refuse",
    "드릴 수 없", "도와드릴 수 없", "제공할 수 없", "답변할 수 없", "답할 수 없", "대답할 수 없", "응답할 수 없",
    "알려 드리기 어렵", "알려드리기 어렵", "드리기 어렵", "답변하기 어렵", "도와드리기 어렵", "응할 수 없",
    "공개할 수 없", "답변하지 않", "답하지 않", "대답하지 않", "질문은 받지 않", "다른 주제로", "알려 드리지 않", "말씀드릴 수 없", "알려 드릴 수 없", "거절", "답변을 거부", "처리할 수 없",
    "kann ich nicht helfen", "kann ich nicht beantworten", "kann ich leider nicht", "leider kann ich",
    "darf ich nicht", "ich darf", "ich kann dazu nicht", "ich kann diese", "ich kann ihnen dabei nicht",
    "ich möchte das nicht", "muss ich ablehnen", "nicht weitergeben", "keine auskunft", "nicht gestattet",
]

# Saying that the source cannot be read is an answer here.
UNREADABLE = re.compile(
    r"unreadable|illegible|not legible|(?:can't|cannot|can not|could not|couldn't) (?:be )?(?:read|made out|make out)\b"
    r"|too (?:blurred|blurry|small|faded) to read|읽을 수 없|판독|알아볼 수 없|unlesbar|nicht lesbar|nicht zu lesen",
    re.I,
)

# Frequent function words by language (Korean and all that isn't written in Latin is told by its script).
STOPWORDS = {
    "en": frozenset(
        "the a an of to in on at is are was were be been has have had that this it its and or but for with by from as "
        "not no which who what when where why how if than then so because since before after only one two some most "
        "any each would could should will can may do does did they we you i he she her his our my your their there "
        "here about into over under between without please read give answer value according".split()
    ),
    "de": frozenset(
        "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren "
        "wird wurde werden hat haben hatte dass weil wenn als ob wie was wer wo warum wann mit von vom zu zum zur im in "
        "am an auf aus bei beim nach vor für über unter durch gegen ohne um es er sie wir ihr ich man sich noch nur "
        "auch so dem dieser diese dieses laut uns mir".split()
    ),
    "es": frozenset(
        "el la los las un una unos unas y o pero no es son era fue ser está de del al en con por para porque que se su "
        "sus lo le como cuando donde antes después durante según nadie había muy más sin sobre hasta desde este esta".split()
    ),
    "fr": frozenset(
        "le la les un une des et ou mais ne pas est sont était a été de du au aux en avec par pour parce que qui se sa "
        "son ses il elle ils elles on nous vous ce cette ces car après avant pendant selon personne avait sans sur dans".split()
    ),
}
_MARKS = {"de": re.compile(r"[äöüß]"), "es": re.compile(r"[ñáíóú¿¡]"), "fr": re.compile(r"[éèêàçùœîôû]")}

_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD], None)
_WORD = re.compile(r"(?<![\w-])[^\W\d_]+(?:['’][^\W\d_]+)?(?![\w-])")
_HANGUL = re.compile(r"[가-힣]")
_LATIN = re.compile(r"[A-Za-zªºÀ-ʯḀ-ỿ]")
# Letters that are neither Latin nor Hangul.
_FOREIGN = re.compile(r"[^\W\d_A-Za-zªºÀ-ʯḀ-ỿᄀ-ᇿ\u3130-\u318f\ua960-\ua97f가-\ud7ff]")
_KANA = ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA")
# Scripts that write a word in about two letters, and those whose single letters are symbols of a formula.
_DENSE = frozenset({"ja", "zh", "thai", "lao", "khmer", "myanmar", "tibetan", "yi"})
_SYMBOLS = frozenset({"greek", "hebrew"})
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|「[^」\n]*」|«[^»\n]*»|`[^`\n]*`|'[^'\n]{2,}'(?!\w)")
_END = tuple(".?!。？！")
_ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…)\s*$")
_CLOSERS = "\"'”’」』)]}»`*_"
# Words that a finished sentence does not end with.
_OPEN_WORDS = frozenset(
    "the a an of to in on at is are was were be been has have had that this and or but for with by from as which who "
    "when where why how if than because since before after only whose while although though so not would could should "
    "will can may might must its their his her our my your into onto over under between without about there's "
    "der die das den dem des ein eine einen einem einer und oder aber dass weil wenn als ob wie mit von zu im in am an "
    "auf aus bei nach vor für über unter durch gegen ohne um ist sind war hat haben wird".split()
)


class RefusalAutomaton:
    """Aho-Corasick automaton over the refusal phrases (goto, failure and output tables)."""

    def __init__(self, phrases: list[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.hit = [False]
        for phrase in phrases:
            at = 0
            for ch in phrase:
                if ch not in self.step[at]:
                    self.step.append({})
                    self.hit.append(False)
                    self.step[at][ch] = len(self.step) - 1
                at = self.step[at][ch]
            self.hit[at] = True
        self.fail = [0] * len(self.step)
        queue = list(self.step[0].values())
        for at in queue:
            for ch, to in self.step[at].items():
                back = self.fail[at]
                while back and ch not in self.step[back]:
                    back = self.fail[back]
                self.fail[to] = self.step[back].get(ch, 0)
                self.hit[to] = self.hit[to] or self.hit[self.fail[to]]
                queue.append(to)

    def first_end(self, text: str) -> int:
        """Offset just after the first phrase that ends in ``text``; -1 without one."""
        at = 0
        for i, ch in enumerate(text):
            while at and ch not in self.step[at]:
                at = self.fail[at]
            at = self.step[at].get(ch, 0)
            if self.hit[at]:
                return i + 1
        return -1


_REFUSAL = RefusalAutomaton(REFUSALS)
#: Beginnings of the phrases, one of which any text with a phrase has.
_MAY_REFUSE = re.compile("|".join(map(re.escape, sorted({p[:6] for p in REFUSALS}))))


class SuffixAutomaton:
    """Suffix automaton of a word sequence."""

    def __init__(self, items: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        last = 0
        for x in items:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, items: list[str], least: int) -> list[bool]:
        """Which of ``items`` lie in a run of ``least`` or more that the sequence also has."""
        opens = [0] * (len(items) + 1)  # runs that begin, less those that end
        state = length = 0
        for i, x in enumerate(items):
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if x in self.next[state]:
                state = self.next[state][x]
                length += 1
            else:
                state = length = 0
            if length >= least:
                opens[i - length + 1] += 1
                opens[i + 1] -= 1
        return [depth > 0 for depth in accumulate(opens[:-1])]


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_INVISIBLE).replace("’", "'").strip()


def _words(text: str) -> list[str]:
    return re.findall(r"\w+(?:[.,:/'-]\w+)*", text.lower())


@lru_cache(maxsize=1 << 16)
def _script(ch: str) -> str:
    """The script of a letter, by its Unicode name."""
    return unicodedata.name(ch, "UNKNOWN").split()[0]


def _foreign(body: str, words: list[str]) -> str | None:
    """``ja``, ``zh`` or the name of another script (``cyrillic``) that outweighs the Latin and Hangul words."""
    letters = _FOREIGN.findall(body)
    if not letters:
        return None
    count = Counter(map(_script, letters))
    kana = sum(count.pop(k, 0) for k in _KANA)
    han = count.pop("CJK", 0) + count.pop("IDEOGRAPHIC", 0)
    sizes = {k.lower(): n for k, n in count.items()} | {"ja" if kana else "zh": kana + han}
    weigh = lambda k, n: 2.5 * n if k in _DENSE else float(n)  # noqa: E731  a dense letter says as much as 2.5 Latin ones
    name = max(sizes, key=lambda k: (weigh(k, sizes[k]), k))
    rest = sum(len(_LATIN.findall(w)) + 2.5 * len(_HANGUL.findall(w)) for w in words)
    least = 4 if name in _SYMBOLS else 2
    return name if sizes[name] >= least and weigh(name, sizes[name]) > rest else None


def language(text: str) -> str | None:
    """By script (``ja``, ``zh``, ``cyrillic``, ...; ``ko``), else by votes of the words outside of quotes; None for a bare value."""
    body = _QUOTED.sub(" ", text)
    words = [w.lower() for w in _WORD.findall(body)]
    if foreign := _foreign(body, words):
        return foreign
    if not words:
        return None
    hangul = sum(1 for w in words if _HANGUL.search(w)) if _HANGUL.search(body) else 0
    latin = len(words) - hangul
    if hangul and (hangul >= 2 or len(body.strip()) <= 12 or hangul >= latin) and hangul * 3 >= latin:
        return "ko"
    votes = {k: sum(map(stop.__contains__, words)) for k, stop in STOPWORDS.items()}
    if not body.isascii():
        for k, mark in _MARKS.items():
            votes[k] += sum(bool(mark.search(w)) for w in words)
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    return best if votes[best] and (latin >= 3 or hangul) else None


def open_delimiters(text: str) -> int:
    """Depth of the delimiter stack at the end of the text (apostrophes inside words don't count)."""
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "」": "「", "»": "«"}
    stack: list[str] = []
    for ch in text:
        if ch in "([{“「«":
            stack.append(ch)
        elif ch in pairs:
            if stack and stack[-1] == pairs[ch]:
                stack.pop()
        elif ch in "\"`":
            if ch in stack:
                while stack and stack.pop() != ch:
                    pass
            else:
                stack.append(ch)
    return len(stack)


def _finished(text: str) -> bool:
    return text.rstrip(_CLOSERS + " ").endswith(_END)


def _is_value(gold: str) -> bool:
    """A short datum (code, amount, time, part name) rather than a sentence."""
    return len(gold) <= 40 and not gold.rstrip().endswith(_END) and len(gold.split()) <= 4


def _overlaps(text: str, start: str) -> Iterator[int]:
    """Lengths of the beginnings of ``start`` that ``text`` ends with, longest first (prefix function, linear)."""
    last = text[-len(start) :]
    both = start + "\0" + last
    reach = [0] * len(both)
    for i in range(1, len(both)):
        k = reach[i - 1]
        while k and both[i] != both[k]:
            k = reach[k - 1]
        reach[i] = k + (both[i] == both[k])
    k = reach[-1] if last else 0
    while k:
        yield k
        k = reach[k - 1]


def _cut_gold(answer: str, gold: str) -> bool | None:
    """True: the answer ends inside ``gold``; False: it ends with all of it, or between its sentences."""
    a, g = answer.lower(), gold.lower()
    if not g:
        return None
    elided = bool(_ELLIPSIS.search(a))
    a = _ELLIPSIS.sub("", a).rstrip()
    core = g.rstrip(" .?!…。")
    bare = a.rstrip(" .?!…。" + "\"'")
    if core and bare.endswith(core):
        return False
    tail = a.rstrip()
    best = 0
    for k in _overlaps(tail, g):
        if (k == len(tail) or not tail[-k - 1].isalnum() and tail[-k - 1] not in "-.,:$"):
            best = k
            break
    if not best:
        return None
    if elided:
        return True
    if _is_value(gold):
        return True if best < len(core) else False
    if best < 12 and best < len(tail):
        return None
    head, rest = g[:best].rstrip(), g[best:]
    if not rest.strip(" .?!…。\"'") or head.endswith(_END) or head.rstrip(_CLOSERS).endswith(_END):
        return False
    if rest[:1] in ".?!" and not rest[1:2].isalnum():
        return False
    return True


def _truncated(question: str, gold: list[str], answer: str) -> bool:
    verdicts = [v for g in gold if (v := _cut_gold(answer, _plain(g))) is not None]
    if False in verdicts:
        return False
    if True in verdicts:
        return True
    words = answer.split()
    if _ELLIPSIS.search(answer):
        return len(words) > 1 or len(answer) > 6
    if _finished(answer):
        return False
    if len(words) >= 3 and gold and all(_is_value(g) for g in gold) and not re.search(r"\d", answer):
        return True
    words = answer.split()
    if not words:
        return False
    last = words[-1].lower().strip(_CLOSERS)
    if last in _OPEN_WORDS or answer[-1] in ",;:-–—($#/=&+":
        return True
    if len(words) >= 4 and open_delimiters(answer):
        return True
    return False


def classify_pair(question: str | None, gold: list[str] | None, answer: str | None) -> str | None:
    """The defect of one pair, or None."""
    text = _plain(answer or "")
    squeezed = " ".join(re.sub(r"[^\w]+", " ", text.lower()).split())
    if squeezed.replace("_", "").strip() in NOTHING:
        return "empty"
    ask = _plain(question or "")
    refs = [g for g in (gold if gold is not None else []) if isinstance(g, str) and g.strip()]
    lowered = " ".join(text.lower().split())
    unreadable = len(text) <= 60 and bool(UNREADABLE.search(lowered))
    if not unreadable:
        quoted_out = _QUOTED.sub(" ", lowered) if lowered[:1] != "\"" else lowered
        end = _REFUSAL.first_end(quoted_out) if _MAY_REFUSE.search(quoted_out) else -1
        if 0 <= end and not any(_plain(g).lower() in lowered for g in refs):
            return "refusal"
    if ask:
        copied = _words(ask)
        said = _words(text)
        if said and copied:
            marks = SuffixAutomaton(copied).covered(said, min(3, len(copied)))
            left = [w for w, m in zip(said, marks) if not m]
            if sum(marks) >= 0.8 * len(copied) and all(w in _COPY_FRAME for w in left) and len(left) <= 6:
                return "copied_question"
        if not unreadable:
            asked, spoken = language(ask), language(text)
            if spoken and spoken != "ko" and spoken not in STOPWORDS:
                if any(_plain(g).lower() == lowered for g in refs) or spoken == "zh" and asked == "ja" and not _finished(text):
                    spoken = None  # the datum as it stands in the source; names in kanji
                elif not asked and _WORD.search(_QUOTED.sub(" ", ask)):
                    asked = "latin"  # no votes, yet words of another script
            if asked and spoken and asked != spoken:
                return "other_language"
    if not unreadable and _truncated(ask, refs, text):
        return "truncated"
    return None


# Words that may frame a repeated question without adding anything.
_COPY_FRAME = frozenset(
    "question q the your was is asked you user prompt query ask here it and a answer repeat repeated following "
    "질문 문의 frage die ihre lautet".split()
)


def flag_defects(turns: DataFrame, keys: tuple[str, ...] = ("attempt_id", "turn")) -> DataFrame:
    """One row ``keys + defect`` for each defective turn.

    ``turns`` needs ``question``, ``gold``, ``answer`` and the keys; ``received_at`` picks the last
    of several deliveries when it is there.  Deliveries are reduced by a map-side aggregate, so a
    turn delivered very often is no hot task.
    """
    order = F.col("received_at") if "received_at" in turns.columns else F.lit(0)
    pair = F.struct("question", "gold", "answer")
    one = turns.groupBy(*keys).agg(F.max_by(pair, F.struct(order.alias("o"), F.xxhash64("answer").alias("h"))).alias("p"))
    rows = one.select(*keys, "p.question", "p.gold", "p.answer")
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", defect string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["defect"] = [classify_pair(q, g, a) for q, g, a in zip(pdf["question"], pdf["gold"], pdf["answer"])]
            hit = pdf.loc[pdf["defect"].notna(), [*keys, "defect"]]
            if len(hit):  # Arrow has no type for an empty frame's columns
                yield hit

    return rows.mapInPandas(run, schema)
