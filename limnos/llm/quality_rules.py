"""Quality rules: a threshold table compiled into one projection of SQL functions.

Each rule is a row (measure, lowest, highest) of a table. ``compile_rules`` turns the table into columns over the
measures, and the measures are expressions over the text: no user function and no shuffle; a text never leaves its row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from limnos.functions.nulls import col

# White space between words, symbols, and frequent function words of the four languages.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the of and to in a is that it with as for was on are by be this from at or an "
              "der die das und in den von zu mit ist im nicht ein eine auf dem des "
              "de la le et les des en un une que pour dans est pas sur du "
              "el los las y por con para del se al como su").split()
#: Their usual spellings, compared as they are.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})
GRAM = 5


class Rule(NamedTuple):
    """A document fails if the measure lies outside the bounds (a null bound is open)."""
    name: str
    measure: str
    lowest: float | None
    highest: float | None


#: Base rules of the contract; the integer form keeps the bounds exact.
BASE_RULES = (Rule("base_words", "n_words", 10, None), Rule("base_repeats", "repeat_excess", None, 0))
#: Verdict of the method: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_words", 1, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.5),
)


def let(value: Column, body) -> Column:
    """``body`` of a value computed once in the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but the six white-space characters; none for a blank text."""
    return F.array_remove(F.split(F.regexp_replace(text, "[\\x09-\\x0D]+", " "), " "), "")


def repeated_words(words: Column) -> Column:
    """Words inside a window of ``GRAM`` words that the text has twice or more, the first time included.

    Windows are compared by a 64-bit hash of their words' hashes. A text without an equal pair stops there; else the
    windows are sorted by hash once, those with an equal neighbour are put in order of place, and the words they cover are summed
    as gaps between them: n log n in the words, also in very long texts.
    """
    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (GRAM - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(GRAM)]))
        return let(windows, of_windows)

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, covered))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), gaps)

    def gaps(p: Column) -> Column:
        gap = F.transform(p, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(p, k + 1) - x, F.lit(GRAM))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < GRAM + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def measures(text: Column) -> Column:
    """Struct of all measures of a text; each is computed once in the row."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("stop_words"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice"))).alias("lines"))

    return let(let(words_of(body), of_words), lambda m: F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["twice"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), m["stop_words"].alias("stop_words"),
        (100 * m["n_repeat_words"] - 20 * m["n_words"]).alias("repeat_excess"),
        ratio(m["word_chars"], m["n_words"]).alias("mean_word_length"),
        ratio(m["n_symbols"], m["n_words"]).alias("symbols_per_word"),
        ratio(m["lines"]["twice"], m["lines"]["n"]).alias("duplicate_line_ratio")))


def compile_rules(rules: Sequence[Rule], measured: Column) -> Column:
    """True if a rule of the table fails; a measure that is null (a ratio of nothing) fails no rule."""
    failed = F.lit(False)
    for rule in rules:
        if rule.lowest is not None:
            failed = failed | F.coalesce(measured[rule.measure] < rule.lowest, F.lit(False))
        if rule.highest is not None:
            failed = failed | F.coalesce(measured[rule.measure] > rule.highest, F.lit(False))
    return failed


def score_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` of each document.

    A null or empty text has no words and fails the base rule. Repeated rows and repeated or null ids are scored row
    by row. An empty table gives an empty result; columns beyond the two are not read.
    """
    q = docs.select(col(doc_id).alias("doc_id"), measures(col(text)).alias("q"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col("q")[c].alias(c) for c in shown], compile_rules(BASE_RULES, F.col("q")).alias("base_failed"),
                    (~(compile_rules(BASE_RULES, F.col("q")) | compile_rules(rules, F.col("q")))).alias("kept"),
                    *[F.col("q")[c].alias(c) for c in ("stop_words", "mean_word_length", "symbols_per_word", "duplicate_line_ratio")])


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents no rule rejects, with their own columns, whatever their names; null and empty texts go, repeated rows stay or go together."""
    return docs.where(let(measures(col(text)), lambda m: ~(compile_rules(BASE_RULES, m) | compile_rules(rules, m))))
