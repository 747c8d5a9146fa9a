"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every document is judged on its own row: no exchange and no Python. NULL texts count as empty, have
no words and so fail the base rule. Repeated rows are judged alike; columns besides the text pass
through untouched, so their names are free, but for the metric names this module adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import SPACES, bind, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages in use.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au avec ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine er es ist mit nicht sich sie und von zu "
    "como con del el en es la las lo los más no para por que se su un una y"
).split()

MIN_WORDS = 50
REPEATED_SHARE = 50


@dataclass(frozen=True)
class Rule:
    """A document is kept when low <= metric <= high."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")


RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols per word", "symbols_per_word", high=0.2),
    Rule("words that are stop words", "stop_word_share", low=0.02),
    Rule("lines that repeat an earlier line", "dup_line_share", high=0.5),
    Rule("words with a letter", "letter_word_share", low=0.7),
    Rule("letters in upper case", "upper_letter_share", high=0.5),
    Rule("lines that start with a bullet", "bullet_line_share", high=0.9),
    Rule("lines that end with an ellipsis", "ellipsis_line_share", high=0.3),
)


def _repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text, in linear-logarithmic time.

    Windows are 64-bit hashes. If all differ, no more is done. Else (hash, position) pairs are
    sorted, positions whose neighbour has the same hash are kept, and each adds the words up to the
    next kept position, three at most.
    """

    def from_hashes(hashes: Column) -> Column:
        def from_sorted(pairs: Column) -> Column:
            def twin(pair, k):
                left = F.get(pairs, k - 1)["h"]
                right = F.get(pairs, k + 1)["h"]
                return (F.coalesce(left == pair["h"], F.lit(False))) | F.coalesce(
                    right == pair["h"], F.lit(False)
                )

            starts = F.sort_array(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

            def covered(at: Column) -> Column:
                steps = F.transform(
                    at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))
                )
                return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

            return bind(starts, covered)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(pairs, from_sorted)
        )

    def hashes_of(own: Column) -> Column:
        every = F.transform(own, lambda w, i: F.xxhash64(w, F.get(own, i + 1), F.get(own, i + 2)))
        return F.when(F.size(own) < 3, F.array().cast("array<bigint>")).otherwise(
            F.slice(every, F.lit(1), F.greatest(F.size(own) - 2, F.lit(1)))
        )

    return bind(hashes_of(words), from_hashes)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the struct column `_m` of counts and ratios that rules refer to by name."""
    whole = F.coalesce(F.col(text), F.lit(""))
    solid = F.length(F.regexp_replace(whole, SPACES, ""))
    symbols = F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def line_counts(own: Column) -> Column:
        return F.struct(
            F.size(own).alias("n_lines"),
            (F.size(own) - F.size(F.array_distinct(own))).alias("n_dup_lines"),
            F.size(F.filter(own, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias(
                "n_bullets"
            ),
            F.size(
                F.filter(own, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))
            ).alias("n_ellipses"),
        )

    def word_counts(own: Column) -> Column:
        return F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.size(F.filter(own, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).alias("n_stops"),
            F.size(F.filter(own, lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
            _repeated_words(own).cast("long").alias("n_repeat_words"),
        )

    def letters(wanted: str) -> Column:
        return F.length(F.regexp_replace(whole, f"[^{wanted}]+", ""))

    base = docs.withColumns(
        {
            "_w": bind(words_of(F.col(text)), word_counts),
            "_l": bind(lines, line_counts),
            "_chars": solid.cast("long"),
            "_symbols": symbols.cast("long"),
            "_upper": letters(r"\p{Lu}"),
            "_letters": letters(r"\p{L}"),
        }
    )

    def share(part: Column, total: Column) -> Column:
        return F.coalesce(part / F.when(total > 0, total), F.lit(0.0))

    n, m = F.col("_w.n_words"), F.col("_l.n_lines")
    metrics = {
        "n_words": n,
        "word_chars": F.col("_chars"),
        "n_symbols": F.col("_symbols"),
        "n_dup_lines": F.col("_l.n_dup_lines").cast("long"),
        "n_repeat_words": F.col("_w.n_repeat_words"),
        "mean_word_chars": share(F.col("_chars"), n),
        "symbols_per_word": share(F.col("_symbols"), n),
        "stop_word_share": share(F.col("_w.n_stops"), n),
        "letter_word_share": share(F.col("_w.n_letter_words"), n),
        "upper_letter_share": share(F.col("_upper"), F.col("_letters")),
        "dup_line_share": share(F.col("_l.n_dup_lines"), m),
        "bullet_line_share": share(F.col("_l.n_bullets"), m),
        "ellipsis_line_share": share(F.col("_l.n_ellipses"), m),
    }
    return base.withColumn(
        "_m", F.struct(*[c.alias(name) for name, c in metrics.items()])
    ).drop("_w", "_l", "_chars", "_symbols", "_upper", "_letters")


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) over the struct `_m`."""
    n, repeated = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    base_failed = (n < MIN_WORDS) | (repeated * 100 > n * REPEATED_SHARE)
    passed = F.lit(True)
    for rule in rules:
        metric = F.col(f"_m.{rule.metric}")
        if rule.low != float("-inf"):
            passed = passed & (metric >= rule.low)
        if rule.high != float("inf"):
            passed = passed & (metric <= rule.high)
    return base_failed, ~base_failed & passed


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `_m`, base_failed and kept."""
    base_failed, kept = verdict(rules)
    return measured(docs, text).withColumns({"base_failed": base_failed, "kept": kept})
