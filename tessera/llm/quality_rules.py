"""Quality rules as a bitmask ledger: every rule runs once per text, its failure is a bit, policies are masks.

The ledger keeps the measurements and one ``failures`` integer per document.  A policy is a versioned mask of rules
that reject; applying another policy, or asking what a rule alone costs (ablation), is bitwise arithmetic on the
ledger and never reads the texts again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile(r"[0-9]")
REPEAT_WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words", "n_max_word"]


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` never changes once it has been given out."""

    bit: int
    name: str
    fails: str


# Integer conditions only, so every engine decides alike.
RULES = [
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "digits", "100 * n_digits > 20 * word_chars"),
    Rule(7, "huge_word", "n_max_word > 1000"),
]
BASE_RULES = ("few_words", "repeated_windows")

# Versioned policies: the rules that reject.
POLICIES = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols"),
    "v2": (*BASE_RULES, "symbols", "duplicate_lines", "short_words", "long_words", "digits", "huge_word"),
}
POLICY = "v2"


def mask(names) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def repeated_words(words: list[str]) -> int:
    """Words inside a window of five words that occurs twice or more in the text, the first occurrence included."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(REPEAT_WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    groups: dict[tuple[str, ...], list[int]] = {}
    for i in at.tolist():  # equal hashes are confirmed on the words themselves
        groups.setdefault(tuple(words[i:i + REPEAT_WINDOW]), []).append(i)
    hit = np.zeros(len(words), dtype=bool)
    for starts in groups.values():
        if len(starts) > 1:
            for i in starts:
                hit[i:i + REPEAT_WINDOW] = True
    return int(hit.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    lines, dup = duplicate_lines(text)
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(_DIGIT.findall(text)), lines, dup,
            repeated_words(words), max(map(len, words), default=0))


def ledger(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the measurements and the ``failures`` bits to every row; a null text has no words.

    Python measures each text once per Arrow batch; the rules themselves are column expressions over the measurements.
    """
    def make():
        def step(batch: pa.RecordBatch):
            return [list(x) for x in zip(*map(measure, texts(batch, text_col)))]
        return step

    measured = append_columns(docs, make, [T.StructField(m, T.LongType()) for m in MEASURES], drop=drop)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures.cast("long"))


def apply_policy(entries: DataFrame, policy: str = POLICY, column: str = "kept") -> DataFrame:
    """Add the verdict of a policy: true if none of its rules failed."""
    return entries.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    whole = mask(POLICIES[policy])
    hits = entries.select(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("f"))
    counts = hits.groupBy("f").agg(F.count("*").alias("n"))
    sums = []
    for r in rules:
        bit = 1 << r.bit
        failed = F.col("f").bitwiseAND(F.lit(bit).cast("long")) != 0
        sums += [F.sum(F.when(failed, F.col("n")).otherwise(0)).alias(f"fail_{r.name}"),
                 F.sum(F.when(F.col("f") == bit, F.col("n")).otherwise(0)).alias(f"alone_{r.name}")]
    one = counts.agg(F.sum(F.when(F.col("f") == 0, F.col("n")).otherwise(0)).alias("clean"), *sums)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"),
                              F.coalesce(F.col(f"fail_{r.name}"), F.lit(0)).alias("n_failed"),
                              F.coalesce(F.col(f"alone_{r.name}"), F.lit(0)).alias("n_failed_alone"),
                              (F.coalesce(F.col("clean"), F.lit(0)) + F.coalesce(F.col(f"alone_{r.name}"), F.lit(0)))
                              .alias("n_kept_without")) for r in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")
