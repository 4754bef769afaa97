"""Quality rules: a threshold table compiled into one Spark projection (no user functions, no shuffle).

A rule compares one ratio of per-document counts with a closed range.  The
table is data; ``compile_rules`` turns it into Column expressions over the
counts of ``measures``.  Every count covers the whole text.

Defined results: NULL text counts as no text (all counts 0, base failed);
an empty text likewise; repeated rows give repeated results; an empty table
gives an empty table; extra columns are ignored.  Repeated 3-word windows are
found by sorting (hash, position) inside the row, so a text of n words costs
O(n log n) however repetitive it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "it", "on", "a", "was", "as", "are", "this", "by",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "dem", "des", "auf", "für", "im",
    "le", "la", "les", "et", "est", "un", "une", "du", "que", "qui", "dans", "pour", "au", "par", "pas", "sur",
    "el", "los", "las", "y", "es", "una", "del", "se", "por", "con", "para", "su", "en", "de", "no", "al",
)


@dataclass(frozen=True)
class Rule:
    """``low <= top / below <= high``; ``below`` None compares the count itself."""

    name: str
    top: str
    below: str | None = None
    low: float | None = None
    high: float | None = None


#: The default table: length, symbol, stop-word and line rules.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", None, 50, 100_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2, 20),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("exclamation_ratio", "n_exclaim", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id and every count a rule may name, one row per input row."""
    text = F.col("text")
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.char_length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "!").alias("n_exclaim"),
    )
    w, lines = F.col("w"), F.col("l")
    window = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    sorted_ = split.withColumn("s", F.sort_array(window))
    s = F.col("s")
    again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    placed = sorted_.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("s")
    p = F.col("p")
    covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
    stop = [str(x) for x in stop_words]
    return placed.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        "n_exclaim",
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> list[Column]:
    """One boolean Column per rule, true where the rule fails (a ratio over zero counts as 0)."""
    out = []
    for r in rules:
        value = F.col(r.top).cast("double")
        if r.below:
            value = F.when(F.col(r.below) > 0, value / F.col(r.below)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (value > F.lit(float(r.high)))
        out.append(bad.alias(r.name))
    return out


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept`` of every document."""
    m = measures(docs)
    failed = F.array_compact(F.array(*[F.when(c, F.lit(r.name)) for r, c in zip(rules, compile_rules(rules), strict=True)]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
