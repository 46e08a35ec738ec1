"""Agent sessions: content match of answers, compaction epochs, cost views, coverage of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Answers with an opposite, and month abbreviations that also accept the full name.
OPPOSITE = {"yes": "no", "no": "yes", "on": "off", "off": "on"}
MONTHS = {"jan": "january", "feb": "february", "mar": "march", "apr": "april", "may": "may", "jun": "june", "jul": "july", "aug": "august", "sep": "september", "oct": "october", "nov": "november", "dec": "december"}
COMPACT_AFTER = (3, 6)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normal_answer(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\A(?:the answer is|answer:)[\s\x{00A0}]*", "")
    return F.regexp_replace(s, "[\\s\\x{00A0},$\"'`.*]", "")


def matches_gold(answer: Column, gold: Column) -> Column:
    """Whether any accepted answer is given: opposites, whole numbers and months have their own rule."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    plain = normal_answer(answer)
    words = F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))
    numbers = F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))

    def one(g: Column) -> Column:
        n = normal_answer(g)
        return (
            F.when(n.isin(*OPPOSITE), F.array_contains(words, n) & ~F.array_contains(words, _map(OPPOSITE)[n]))
            .when(F.trim(g).rlike(r"\A[\d,]+\z"), F.array_contains(numbers, n))
            .when(n.isin(*MONTHS), (plain == n) | (plain == _map(MONTHS)[n]))
            .otherwise(F.contains(plain, n))
        )

    return F.coalesce(F.exists(F.filter(F.coalesce(gold, F.array().cast("array<string>")), lambda g: g.isNotNull()), one), F.lit(False))


def turn_group(kind: Column) -> Column:
    return F.when(kind.startswith("late"), "late").when(kind.startswith("immediate"), "immediate").otherwise(kind)


def unreadable(answer: Column) -> Column:
    return F.coalesce(F.contains(F.lower(answer), F.lit("unreadable")), F.lit(False))


def latest_turns(turns: DataFrame) -> DataFrame:
    """One row per attempt and turn: the last delivery (an aggregate, so repeats combine map-side)."""
    rest = [c for c in turns.columns if c not in ("attempt_id", "turn")]
    pick = F.max_by(F.struct(*rest), F.struct("received_at", F.xxhash64("answer")))
    return turns.where("attempt_id is not null and turn is not null").groupBy("attempt_id", "turn").agg(pick.alias("r")).select("attempt_id", "turn", "r.*")


def compaction_epochs(turns: DataFrame, tokens: str = "tokens", after: tuple[int, ...] = COMPACT_AFTER) -> DataFrame:
    """Epoch of each turn (compactions before it) and the running tokens since the last compaction."""
    epoch = sum((F.when(F.col("turn") > p, 1).otherwise(0) for p in after), F.lit(0))
    w = Window.partitionBy("attempt_id", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("epoch", epoch).withColumn("running_tokens", F.sum(tokens).over(w))


def cost_views(usage: DataFrame, keys: list[str], price_in: float, price_out: float, read_factor: float, write_factor: float) -> DataFrame:
    """Mean list cost and cache-view cost per group from ``prompt, cached, cache_write, completion``."""
    m = usage.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("prompt", "cached", "cache_write", "completion")])
    out = F.col("completion") * price_out / 1e6
    plain = F.col("prompt") - F.col("cached") - F.col("cache_write")
    seen = plain + F.col("cached") * read_factor + F.col("cache_write") * write_factor
    return m.select(*keys, (F.col("prompt") * price_in / 1e6 + out).alias("list_cost"), (seen * price_in / 1e6 + out).alias("cache_cost"))


def missing_slots(slots: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return slots.join(results.select(*keys).distinct(), keys, "left_anti")


def latest_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last ``ok`` row per key, else the first row."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    per = rows.groupBy(key).agg(F.max_by(rest, F.when(F.col("status") == "ok", F.col(order))).alias("good"), F.min_by(rest, order).alias("first"), F.count(F.when(F.col("status") == "ok", 1)).alias("_ok"))
    pick = F.when(F.col("_ok") > 0, F.col("good")).otherwise(F.col("first"))
    return per.select(key, pick.alias("r")).select(key, "r.*")


def slot_answer(c: Column) -> Column:
    """Normal answer of a graded slot: a trailing ``region`` goes too."""
    return F.regexp_replace(normal_answer(c), r"region\z", "")


def strict_match(answer: Column, gold: Column) -> Column:
    a = slot_answer(answer)
    return F.coalesce(F.exists(gold, lambda g: slot_answer(g) == a), F.lit(False))


def content_match(answer: Column, gold: Column) -> Column:
    a = slot_answer(answer)
    return F.coalesce(F.exists(gold, lambda g: F.contains(a, slot_answer(g))), F.lit(False))


def keywords(question: Column, stop_words: list[str]) -> Column:
    """Distinct words of three characters or more that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(question), "[^a-z0-9\\- ]", " "), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop_words)))


def fuzzy_hit(word: Column, words: Column) -> Column:
    """Equal, or one a prefix of the other when both have four characters or more."""
    long = lambda w: (F.length(w) >= 4) & (F.length(word) >= 4)
    return F.exists(words, lambda w: (w == word) | long(w) & (w.startswith(word) | word.startswith(w)))


def slot_cost(prompt_tokens: Column, max_tokens: int, rounds: int, price_in: float, price_out: float) -> Column:
    """Upper bound of what a slot can cost."""
    return rounds * (prompt_tokens * price_in + max_tokens * price_out) / 1e6
