"""A ledger of quality rules: measurements and failure bits per document, policies and ablations on top.

Every rule is evaluated once per document and leaves one bit; policies are versioned sets of rules,
applied to the bits alone, and ablations need no more than the bits' histogram. All of it is
built-in functions; a repeated window is found by sorting the window hashes of its own document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import WORD_GAP

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails more than `allowed` of the rules named."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


#: Bits are never given anew; a changed rule gets a bit of its own.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 20),
    Rule(1, "repeated_windows", lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    Rule(2, "symbols", lambda: F.col("n_symbols") > F.col("n_words")),
    Rule(3, "duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
    Rule(4, "word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20)),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, (*BASE, "symbols", "duplicate_lines", "word_length")),
}
CURRENT = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once, however often a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more: the union of their positions, by gaps of sorted starts."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, j: (x["h"] == F.get(pairs, j - 1)["h"]) | (x["h"] == F.get(pairs, j + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(any_twice, let(pairs, twice)).otherwise(0)

    def windows(each: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(each) - (window - 1))
        return F.when(F.size(each) > window, let(F.transform(at, lambda i: F.xxhash64(F.slice(each, i, window))), count)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and failures (a bit per rule).

    Null and empty texts have no words or lines and fail few_words. One row per row of docs, in one
    pass without a shuffle; equal windows are told by 64-bit hashes within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("_text"),
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    measured = words.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(0)
    return measured.withColumn("failures", bits.cast("long"))


def failed(mask: int) -> Column:
    return F.bit_count(F.col("failures").bitwiseAND(F.lit(mask).cast("long")))


def apply(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed, policy and kept to a ledger."""
    policy = POLICIES[version]
    base = failed(Policy(0, BASE).mask) > 0
    return entries.withColumns({"base_failed": base, "policy": F.lit(version), "kept": ~base & (failed(policy.mask) <= policy.allowed)})


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that it alone rejects, and that stay without it.

    Works on counts per bit pattern, as many rows as patterns occur and never more than 2 ** rules.
    """
    policy = POLICIES[version]
    patterns = entries.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")).alias("failures")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules])
    each = patterns.select("failures", "n", F.explode(rules).alias("r")).select("failures", "n", "r.*")
    has = F.col("failures").bitwiseAND(F.col("bit")) != 0
    n_failed = F.bit_count("failures")
    without = n_failed - F.when(has, 1).otherwise(0)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    return each.groupBy("rule").agg(
        total(has).alias("n_failed"),
        total((n_failed > policy.allowed) & (without <= policy.allowed)).alias("n_only"),
        total(without <= policy.allowed).alias("n_kept_without"),
    )
