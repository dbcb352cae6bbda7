"""Sentence-weighted sentiment from a word lexicon: a short list, or a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalink.functions.text import let
from catalink.operators.joins import lookup_join
from catalink.words import NEGATIVE_WORDS, POSITIVE_WORDS

SENTENCE_ENDS = r"[.!?\n]+"
NO_WORD = r"[^\p{L}\p{Nd}']+"
# Score of each sentiment bucket.
SCORES = {"not_understood": 0, "very_negative": -2, "negative": -1, "neutral": 0, "positive": 1,
          "very_positive": 2}


def sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, SENTENCE_ENDS), lambda s: F.btrim(s))
    return F.filter(pieces, lambda s: s != "")


def sentence_class(sentence: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """0 (very negative) to 4 (very positive): two plus the balance of lexicon words."""
    words = F.split(F.lower(sentence), NO_WORD)
    good, bad = list(positive), list(negative)
    balance = let(words, lambda w: F.size(F.filter(w, lambda t: t.isin(good)))
                  - F.size(F.filter(w, lambda t: t.isin(bad))))
    return let(balance, lambda b: F.lit(2) + F.greatest(F.lit(-2), F.least(F.lit(2), b)))


def sentiment_mean(text: Column, positive: Sequence[str] = POSITIVE_WORDS,
                   negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """Mean sentence class weighted by sentence length; -1 when there is no sentence."""
    parts = F.transform(sentences(text), lambda s: F.struct(
        F.length(s).cast("double").alias("size"),
        sentence_class(s, positive, negative).cast("double").alias("cls")))

    def weighted(items: Column) -> Column:
        total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["size"])
        mass = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["size"] * x["cls"])
        return F.when(F.size(items) == 0, -1.0).otherwise(F.try_divide(mass, total))

    return let(parts, weighted)


def sentiment_means(texts: DataFrame, lexicon: DataFrame, key: str,
                    text: str = "text") -> DataFrame:
    """(key, m): the same mean for unique keys, with a lexicon table (word, sign) of any size.

    Words are looked up by a join; the balance of a sentence and the mean of a text are sums that
    combine on the map side.
    """
    parts = texts.select(key, F.posexplode_outer(sentences(F.col(text))).alias("k", "s"))
    words = parts.select(key, "k", F.length("s").cast("double").alias("size"),
                         F.explode_outer(F.split(F.lower("s"), NO_WORD)).alias("word"))
    signed = lookup_join(words, lexicon.select("word", "sign"), "word", "left")
    balance = F.greatest(F.lit(-2), F.least(F.lit(2), F.sum(F.coalesce("sign", F.lit(0)))))
    scored = signed.groupBy(key, "k", "size").agg((balance + 2).alias("cls"))
    mean = F.try_divide(F.sum(F.col("size") * F.col("cls")), F.sum("size"))
    return scored.groupBy(key).agg(F.coalesce(mean, F.lit(-1.0)).alias("m"))


def sentiment_bucket(mean: Column) -> Column:
    """Name of the bucket a weighted mean falls in."""
    return (
        F.when(mean <= 0, "not_understood").when(mean < 1, "very_negative")
        .when(mean < 2, "negative").when(mean < 3, "neutral").when(mean < 4, "positive")
        .when(mean < 5, "very_positive").otherwise("not_understood")
    )


def sentiment_score(mean: Column) -> Column:
    """Score -2 .. 2 of a weighted mean."""
    return (
        F.when(mean <= 0, 0).when(mean < 1, -2).when(mean < 2, -1).when(mean < 3, 0)
        .when(mean < 4, 1).when(mean < 5, 2).otherwise(0)
    )
