"""Quality rules as a ledger of failure bits (native).

Every rule is evaluated once for each document; the ledger stores one bit for each failed rule beside the
measurements. Policies are versioned masks over those bits, so a new policy, or an ablation of one, never reads
texts again.

Defined results: a null or blank text has no words and fails ``min_words``; a null ``doc_id`` is kept as null; repeated
rows give repeated rows; other columns of the input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, WS, let, text_of, words

#: Rule name to bit; bits are never reused for another rule.
RULES = {"min_words": 0, "repeated_windows": 1, "word_length": 2, "symbols": 3, "duplicate_lines": 4}
BASE = ("min_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


POLICIES = {"v1": Policy("v1", BASE), "v2": Policy("v2", tuple(RULES))}


def repeat_words(ws: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text."""

    def of_windows(hs: Column) -> Column:
        def spread(order: Column) -> Column:
            twice = F.filter(
                order,
                lambda e, k: (e["h"] == F.get(order, k - 1)["h"]) | (e["h"] == F.get(order, k + 1)["h"]),
            )
            return let(
                F.array_sort(F.transform(twice, lambda e: e["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        tagged = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(F.array_sort(tagged), spread))

    def windows(hs: Column) -> Column:
        return F.transform(
            F.slice(hs, 1, F.greatest(F.size(hs) - (width - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *(F.get(hs, i + k) for k in range(1, width))),
        )

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), of_windows))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document with ``__doc`` (the columns to keep), the measurements and ``failed``, the bits of the rules
    that it fails."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WS))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    m = docs.select(F.struct(*(keep or ("doc_id",))).alias("__doc"), text_of().alias("text")).select(
        "__doc",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(text, f"{WS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    m = m.select("__doc", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    fails = {
        "min_words": F.col("n_words") < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return m.withColumn("failed", bits)


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept``: none of the policy's rules failed."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy would keep without it.

    Counts come from one aggregate over the distinct bit patterns, of which there are at most 2 ** len(RULES).
    """
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("p")).agg(F.count("*").alias("n"))
    rows = []
    for r in policy.rules:
        bit = F.lit(1 << RULES[r]).cast("long")
        others = F.lit(policy.mask & ~(1 << RULES[r])).cast("long")
        rows.append(
            F.struct(
                F.lit(r).alias("rule"),
                F.when(F.col("p").bitwiseAND(bit) != 0, F.col("n")).otherwise(0).alias("fails"),
                F.when(F.col("p") == bit, F.col("n")).otherwise(0).alias("only"),
                F.when(F.col("p").bitwiseAND(others) == 0, F.col("n")).otherwise(0).alias("kept_without"),
            )
        )
    return (
        patterns.select(F.explode(F.array(*rows)).alias("x"))
        .groupBy("x.rule")
        .agg(F.sum("x.fails").alias("fails"), F.sum("x.only").alias("only"), F.sum("x.kept_without").alias("kept_without"))
    )


def digest(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    base = F.lit(Policy("base", BASE).mask).cast("long")
    out = apply_policy(measure(docs), policy).withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0)
    return out.select("__doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"), "failed")


def keep(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """The documents that a policy keeps, with their columns as they were."""
    return apply_policy(measure(docs, *docs.columns), policy).where("kept").select("__doc.*")
