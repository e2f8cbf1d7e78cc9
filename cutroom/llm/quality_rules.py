"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps what was measured and one bit per rule that
failed. Policies are versioned sets of rules, applied to the bits alone; ablations come from bitwise
aggregates of the ledger, without reading a text again.

Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words: all its measures are 0, and it fails
`few_words` only. Repeated rows give repeated ledger rows, an empty table none; a very long text is measured whole,
in one task; columns beside doc_id and text are ignored by ledger() and kept by keep(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import annotate, original
from .words import LINES, SPACED, Text, mix, pieces, windows

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _CAPITAL | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask, never given to another rule. fails: SQL over the measures."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(4, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(5, "capitals", "n_letters >= 20 AND 2 * n_capitals > n_letters"),
)

#: version -> names of the rules that reject. A version, once used, stays as it is.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "word_length", "repeated_lines", "capitals"),
}
CURRENT = 2


def measured(text: Text) -> dict[str, np.ndarray]:
    """The measures of each text of a piece."""
    words = text.words(SPACED)
    n = words.counts()
    start = (text.data & 0xC0) != 0x80
    lines = text.words(LINES)
    filled = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.inside, dtype=np.int64)])
    real = filled[lines.ends] > filled[lines.starts]
    owner = lines.owner()[real]
    n_lines = np.bincount(owner, minlength=len(n))
    keys = lines.hashes[real] + mix(owner.astype(np.uint64) + np.uint64(1))
    distinct = np.bincount(owner[np.unique(keys, return_index=True)[1]], minlength=len(n))
    out = {
        "n_words": n,
        "word_chars": text.per_text(start & words.inside),
        "n_symbols": text.per_text(_SYMBOL[text.data]),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated(words),
        "n_letters": text.per_text(_LETTER[text.data]),
        "n_capitals": text.per_text(_CAPITAL[text.data]),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def repeated(words, width: int = WINDOW) -> np.ndarray:
    """Words of each text in windows found twice or more in that text, the first included."""
    n, total = words.counts(), len(words.hashes)
    marks = np.zeros(total + 1, np.int64)
    if total >= width:
        owner = words.owner()
        inside = owner[: total - width + 1] == owner[width - 1 :]
        keys = windows(words.hashes, width) + mix(owner[: total - width + 1].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(keys[inside])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hits = np.flatnonzero((twice[at] == keys) & inside)
            np.add.at(marks, hits, 1)
            np.subtract.at(marks, hits + width, 1)
    covered = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.cumsum(marks[:-1]) > 0, dtype=np.int64)])
    return covered[words.bounds[1:]] - covered[words.bounds[:-1]] if len(n) else n


def _measures(docs: DataFrame) -> DataFrame:
    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    return annotate(docs, fields, lambda: lambda text: [pa.array(found[m]) for found in [measured(text)] for m in MEASURES])


def _with_bits(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules), F.lit(0).cast("bigint"))
    return rows.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, all measures and fail_bits: bit b is set if the rule with that bit failed. No shuffle."""
    rows = _measures(docs.select("doc_id", "text"))
    return _with_bits(rows.select(F.col("__0").alias("doc_id"), *MEASURES), rules)


def keep(docs: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns. No shuffle."""
    return original(apply_policy(_with_bits(_measures(docs), rules), version).filter("kept"), docs)


def mask(version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in POLICIES[version])


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """rows (a ledger) with policy_version and kept: no rule of that policy failed."""
    return rows.withColumns({"policy_version": F.lit(version), "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("bigint")) == 0})


def ablation(rows: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it rejects (kept without it).

    Documents are counted by mask first, so what is shuffled is one row per mask and task.
    """
    used = [r for r in rules if r.name in POLICIES[version]]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("bigint"))
    by_mask = rows.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in used)))
    return (
        by_mask.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.bit_or("bits").alias("bits_seen"),
        )
    )
