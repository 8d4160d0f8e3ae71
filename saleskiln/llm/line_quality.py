"""Line-first cleaning: rules decide line by line, failed lines go, and a document that loses too much text is rejected.

Column functions only. Nothing is exploded: every text is judged inside its own row, so there is no shuffle, and the
cost of a row is that of sorting its windows at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.llm.common import SPACE_CLASS, SPACES, unused_name

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: A document must keep at least this percentage of its words.
KEEP_PERCENT = 40
#: A line fails with more symbols, or exclamation marks, per hundred words than these.
SYMBOL_PERCENT, SHOUT_PERCENT = 10, 60
#: A line with so many separators between its words is a menu.
MENU_MARKS = 3
WORD = "[^\\x20\\x09-\\x0D]"
SENTENCE_MARK = "[.!?:;\\u2026\\u3002\\uFF01\\uFF1F]"
MENU_MARK = "[|\\u00BB\\u203A\\u2022\\u00B7>]"
BOILERPLATE = (
    "(?i)(all rights reserved|accept (all )?cookies|use of cookies|enable javascript|privacy policy|terms of (use|service)"
    "|lorem ipsum|share (this )?on (facebook|twitter)|sign up for our newsletter|click here to)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it inside loops."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text has twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeats(ordered: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(ordered, k)["h"] == s["h"], F.lit(False))
        return F.transform(F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])

    def from_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(pairs, lambda ordered: let(F.sort_array(repeats(ordered)), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(0)

    def from_words(w: Column) -> Column:
        last = F.size(w) - window
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, window)))
        return F.when(last > 0, let(hashes, from_hashes)).otherwise(0)

    return let(words, from_words)


def line_fails(line: Column, words: Column) -> Column:
    """Punctuation, navigation and boilerplate rules of a line with ``words`` words."""
    return (
        ~line.rlike(SENTENCE_MARK)
        | (100 * count_of(line, SYMBOLS) > SYMBOL_PERCENT * words)
        | (100 * count_of(line, "!") > SHOUT_PERCENT * F.greatest(words, F.lit(3)))
        | (F.size(F.split(line, MENU_MARK)) > MENU_MARKS)
        | line.rlike(BOILERPLATE)
    )


def clean_lines(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words,
    cleaned_text (the lines that pass) and kept.

    A null text has no words; so has an empty one: both fail for having fewer than 20. A line without words is neither
    judged nor counted. Equal rows get equal results, an empty table gives none, columns of these names are replaced.
    """
    text, work = F.coalesce(F.col(text_column), F.lit("")), unused_name(docs, "_work")
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(WORD))
    judged = F.transform(lines, lambda l: let(F.size(words_of(l)), lambda n: F.struct(l.alias("line"), n.alias("n"), line_fails(l, n).alias("fails"))))
    passed = F.filter(F.col(work)["judged"], lambda x: ~x["fails"])
    out = docs.withColumn(work, F.struct(words_of(text).alias("words"), judged.alias("judged")))
    seen = F.col(work)["judged"]["line"]
    measured = {
        "n_words": F.size(F.col(work)["words"]).cast("bigint"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": count_of(text, SYMBOLS).cast("bigint"),
        "n_dup_lines": let(seen, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col(work)["words"]).cast("bigint"),
        "n_kept_words": F.aggregate(passed, F.lit(0), lambda a, x: a + x["n"]).cast("bigint"),
        "cleaned_text": F.array_join(F.transform(passed, lambda x: x["line"]), "\n"),
    }
    out = out.withColumns(measured).drop(work)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("n_kept_words") >= KEEP_PERCENT * F.col("n_words")))
