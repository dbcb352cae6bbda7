"""Suffix stemming as regular expressions over one column.

Vowels are ``aeiouy``; a ``y`` at word start or after a vowel is written ``Y`` first and
so counts as a consonant. With that marker the number of vowel-consonant runs of a word
is a plain character-class pattern, which keeps the stemmer inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalink.functions.text import let
from catalink.words import STEM_FINAL_SUFFIXES, STEM_LONG_SUFFIXES, STEM_SHORT_SUFFIXES

ONE_RUN = "[aeiouy][^aeiouy]"
TWO_RUNS = "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
SHORT_SYLLABLE = "[^aeiouy][aeiouy][^aeiouywxY]$"


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _only_one_run(word: Column) -> Column:
    return word.rlike(ONE_RUN) & ~word.rlike(TWO_RUNS)


def _mark_y(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "([aeiou])y", "$1Y"), "^y", "Y")


def _plurals(word: Column) -> Column:
    return F.regexp_replace(word, "(?:(ss|i)es|([^s])s)$", "$1$2")


def _repair(stem: Column) -> Column:
    return (
        F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(r".([^aeiouylsz])\1$"), _cut(stem, 1))
        .when(_only_one_run(stem) & stem.rlike(SHORT_SYLLABLE), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _past_and_gerund(word: Column) -> Column:
    return (
        F.when(word.endswith("eed"), F.when(_cut(word, 3).rlike(ONE_RUN), _cut(word, 1)).otherwise(word))
        .when(word.rlike("[aeiouy].*ed$"), let(_cut(word, 2), _repair))
        .when(word.rlike("[aeiouy].*ing$"), let(_cut(word, 3), _repair))
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    return F.regexp_replace(word, "([aeiouy].*)[yY]$", "$1i")


def _swap_suffix(word: Column, table: dict[str, str], runs: str) -> Column:
    """Swap the longest listed suffix when what precedes it matches ``runs``."""
    found = F.regexp_extract(word, f"(?:{'|'.join(table)})$", 0)
    swaps = F.create_map(*[F.lit(text) for pair in table.items() for text in pair])

    def swap(suffix: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - F.length(suffix))
        allowed = (suffix != "") & stem.rlike(runs)
        return F.when(allowed, F.concat(stem, F.coalesce(swaps[suffix], F.lit("")))).otherwise(word)

    return let(found, swap)


def _long_suffixes(word: Column) -> Column:
    return _swap_suffix(word, STEM_LONG_SUFFIXES, ONE_RUN)


def _short_suffixes(word: Column) -> Column:
    return _swap_suffix(word, STEM_SHORT_SUFFIXES, ONE_RUN)


def _final_suffixes(word: Column) -> Column:
    table = {("(?<=[st])ion" if s == "ion" else s): "" for s in STEM_FINAL_SUFFIXES}
    return _swap_suffix(word, table, TWO_RUNS)


def _final_e(word: Column) -> Column:
    droppable = word.rlike(TWO_RUNS) | (
        word.rlike(ONE_RUN) & ~_cut(word, 1).rlike(SHORT_SYLLABLE)
    )
    return F.when(word.endswith("e") & droppable, _cut(word, 1)).otherwise(word)


def _double_l(word: Column) -> Column:
    return F.when(word.rlike(".ll$") & word.rlike(TWO_RUNS), _cut(word, 1)).otherwise(word)


STEPS = (_mark_y, _plurals, _past_and_gerund, _final_y, _long_suffixes, _short_suffixes,
         _final_suffixes, _final_e, _double_l)


def stem(word: Column, lowercase: bool = False) -> Column:
    """Stem one lowercase word; words under three letters stay as they are.

    A ``Y`` marker may stay in the result; ``lowercase`` folds it back.
    """
    value = word
    for step in STEPS:
        value = let(value, step)
    stemmed = F.when(F.length(word) < 3, word).otherwise(value)
    return F.lower(stemmed) if lowercase else stemmed


def stem_tokens(tokens: Column, lowercase: bool = False) -> Column:
    return F.transform(tokens, lambda w: stem(w, lowercase))
