"""Whole-text statistics as DataFrame expressions: one struct per text, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import BLANKS, let

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _covered(positions: Column) -> Column:
    """How many places the windows of three cover that start at these ascending positions."""
    n = F.size(positions)
    gaps = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == n, F.lit(3)).otherwise(F.least(F.lit(3), F.get(positions, k) - F.get(positions, k - 1))))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g))


def _repeats(words: Column) -> Column:
    """Words inside windows that occur twice or more. Hashes tell where a window may be repeated; only those windows become texts, which are sorted with their places and compared."""

    def equal_to_next(s: Column, field: str) -> Column:
        """The places of sorted pairs that equal one beside them."""
        n = F.size(s)
        same = lambda a, b: F.get(s, a)[field] == F.get(s, b)[field]
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.when((k > 0) & same(k, F.greatest(k - 1, F.lit(0))), F.lit(True)).otherwise((k < n - 1) & same(k, F.least(k + 1, n - 1))))
        return F.transform(at, lambda k: F.get(s, k)["at"])

    # Words hold no space, so windows joined by spaces are equal where their words are.
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def by_words(places: Column) -> Column:
        pairs = F.array_sort(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("at"))))
        repeated = let(pairs, lambda s: F.array_sort(equal_to_next(s, "w")))
        return F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(let(repeated, _covered))

    def by_hash(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(none, F.lit(0).cast("long")).otherwise(let(let(pairs, lambda s: equal_to_next(s, "h")), by_words))

    return let(_window_hashes(words), by_hash)


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of three words, in order."""
    n = F.size(words)
    some = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(some)


def text_stats(text: Column, more: bool = False) -> Column:
    """Struct of longs: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null text has no words.

    n_lines counts \\n-split lines with a word, n_dup_lines those equal to an
    earlier one. more adds n_chars, n_distinct, n_upper, n_bangs, n_digits.
    """

    def fields(t: Column) -> Column:
        def with_words(words: Column) -> Column:
            out = [F.size(words).cast("long").alias("n_words"), F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars")]
            out.append((F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
            lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
            both = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
            out += [both["n"].alias("n_lines"), both["dup"].alias("n_dup_lines"), _repeats(words).alias("n_repeat_words")]
            if more:
                count = lambda drop: (F.char_length(t) - F.char_length(drop)).cast("long")
                out += [
                    F.char_length(t).cast("long").alias("n_chars"),
                    F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                    count(F.regexp_replace(t, "\\p{Lu}+", "")).alias("n_upper"),
                    count(F.translate(t, "!", "")).alias("n_bangs"),
                    count(F.translate(t, "0123456789", "")).alias("n_digits"),
                ]
            return F.struct(*out)

        return let(words_of(t), with_words)

    return let(F.coalesce(text, F.lit("")), fields)
