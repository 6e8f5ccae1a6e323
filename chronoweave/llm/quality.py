"""Line-first quality rules.

Every line is judged by itself: does it end like a sentence, is it a navigation
bar, is it boilerplate?  Failing lines are taken out, and a document that loses
too much of its text that way is rejected, as is one that fails the base rules
on its whole text.  Column expressions only; no shuffle, so one source holding
most of the rows costs nothing extra.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import BLANKS, WORD, let, total

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOSS_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# Signs that close a sentence, and quotes or brackets that may follow them.
SENTENCE_ENDS = ".!?:;…。！？"
CLOSERS = "\"'”’»)]"
# Line terminators other than white space; one may end a line.
TERMINATORS = "\u0085\u2028\u2029"
# Signs between the entries of a navigation bar.
NAVIGATION_SIGNS = "|»›•>"
NAVIGATION_SIGN = rf"(?:^|[\x20\x09])[{NAVIGATION_SIGNS}](?=[\x20\x09]|$)"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "share this", "sign in to", "skip to content", "subscribe to our", "terms of use", "use of cookies",
)


def _without(text: Column, signs: str) -> Column:
    return reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit("")), signs, text)


def _chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(_without(text, BLANKS)).cast("long")


def _split_words(text: Column) -> Column:
    """Words in order; splitting at a single sign needs no pattern."""
    blank = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(" ")), BLANKS[1:], text)
    return F.array_remove(F.split(blank, " "), "")


def _has_words(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _ends_with(line: Column, signs: str) -> Column:
    return reduce(or_, [F.endswith(line, F.lit(sign)) for sign in signs])


def _closed(line: Column) -> Column:
    """Whether a line ends a sentence, apart from white space, quotes and brackets."""
    whole = F.when(_ends_with(line, TERMINATORS), F.left(line, F.length(line) - 1)).otherwise(line)
    return _ends_with(F.rtrim(F.rtrim(whole, F.lit(BLANKS)), F.lit(CLOSERS)), SENTENCE_ENDS)


def line_fails(line: Column) -> Column:
    """Whether a line with words fails the punctuation, navigation or boilerplate rule."""
    signs = F.regexp_count(line, F.lit(NAVIGATION_SIGN))
    # most lines hold no such sign at all
    navigation = reduce(or_, [F.contains(line, F.lit(sign)) for sign in NAVIGATION_SIGNS])
    navigation = navigation & (signs >= 3) & (signs * 5 >= F.regexp_count(line, F.lit(WORD)))
    boilerplate = let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE]))
    return ~_closed(line) | navigation | boilerplate


def repeated_words(found: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are hashed first.  Only a text with equal hashes goes on: its
    windows are sorted with their words, so that equal means equal words, and
    the length of the union of the repeated windows is summed.
    """
    starts = F.size(found) - (WINDOW - 1)

    def wider(hashes: Column, by: int) -> Column:
        """Hashes of windows that are wider by so many words; the array stays as long."""
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + by)))

    def whole_windows(hashes: Column, width: int) -> Column:
        return F.slice(hashes, 1, F.size(hashes) - (width - 1))

    def repeats(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) < F.size(hashes)

    def covered(hashes: Column) -> Column:
        rows = F.array_sort(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(found, i + 1, WINDOW).alias("w"), i.alias("i")))
        )

        def equal(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

        def at(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
            return total(gaps)

        return let(let(rows, at), length)

    def count(halves: Column) -> Column:
        # a window that is there twice has its first half there twice
        eights = let(wider(halves, WINDOW // 2), lambda h: whole_windows(h, WINDOW))
        full = let(eights, lambda h: F.when(repeats(h), covered(h)).otherwise(none))
        return F.when(repeats(whole_windows(halves, WINDOW // 2)), full).otherwise(none)

    none = F.lit(0).cast("long")
    ones = F.transform(found, lambda w: F.xxhash64(w))
    halves = let(let(ones, lambda h: wider(h, 1)), lambda h: wider(h, 2))
    return F.when(starts >= 2, let(halves, count)).otherwise(none)


def _by_lines(whole: Column, lines: Column, fails: Column) -> Column:
    """Number and characters of the failing lines, and the text without them."""
    failing = F.filter(lines, lambda x, i: F.get(fails, i))
    left = F.filter(lines, lambda x, i: ~F.get(fails, i))
    return F.struct(
        F.size(failing).cast("long").alias("n_failed_lines"),
        total(F.transform(failing, _chars)).alias("lost"),
        F.when(F.array_contains(fails, True), F.array_join(left, "\n")).otherwise(whole).alias("clean_text"),
    )


def judge_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` that do not clash, plus the measures and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, n_failed_lines, lost_percent (of the characters that are not
    white space, rounded down), clean_text and kept.  A null or empty text has
    no words, so it fails the base rules; its clean_text is empty.  A column of
    `docs` named like an added one is replaced.  Equal rows are judged alike
    and all stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")

    def judged(of: Column) -> Column:
        # each line is judged once; what depends on it is one value, also where a filter on it is pushed down
        return let(F.transform(of, lambda x: _has_words(x) & line_fails(x)), lambda fails: _by_lines(whole, of, fails))

    def counted(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).alias("n_repeat_words"))

    out = docs.withColumns({"_quality_lines": let(lines, judged), "_quality_words": let(_split_words(whole), counted)})
    out = out.withColumns(
        {
            "n_words": F.col("_quality_words.n_words"),
            "word_chars": _chars(whole),
            "n_symbols": (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long"),
            "n_dup_lines": let(F.filter(lines, _has_words), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
            "n_repeat_words": F.col("_quality_words.n_repeat_words"),
            "n_failed_lines": F.col("_quality_lines.n_failed_lines"),
            "clean_text": F.col("_quality_lines.clean_text"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("_quality_lines.lost")
    out = out.withColumns(
        {
            "base_failed": failed,
            "lost_percent": F.when(F.col("word_chars") > 0, F.floor(lost * 100 / F.col("word_chars"))).otherwise(0).cast("long"),
            "kept": ~failed & (lost * 100 <= F.col("word_chars") * MAX_LOSS_PERCENT),
        }
    )
    return out.drop("_quality_lines", "_quality_words")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines and with n_chars of what is left."""
    judged = judge_documents(docs).filter("kept")
    return judged.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(docs.columns)
