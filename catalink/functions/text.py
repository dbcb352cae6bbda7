"""Token and text expressions: every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from catalink.words import PHRASE_STOP_WORDS, VECTOR_STOP_WORDS

BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[ \t\n\x0B\f\r]"
EMPTY_STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


# ---------------------------------------------------------------- tokens

def tokenize(text: Column) -> Column:
    """Lowercase and split on single blanks; trailing empty tokens vanish, inner ones stay."""
    only_blanks = text.rlike(rf"\A{BLANK_CLASS}+\z")
    trimmed = F.rtrim(F.lower(text), F.lit(BLANKS))
    return F.when(only_blanks, no_strings()).otherwise(F.split(trimmed, BLANK_CLASS))


def drop_stop_words(tokens: Column, words: Sequence[str] = VECTOR_STOP_WORDS) -> Column:
    words = list(words)
    return F.filter(tokens, lambda w: ~w.isin(words))


def mark_links(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.when(w.startswith("http"), "<url>").otherwise(w))


def mark_mentions(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.when(w.startswith("@"), "<username>").otherwise(w))


def is_numeric(token: Column) -> Column:
    """True when every character is a decimal digit; an empty token counts as numeric.

    Tokens that begin with a Latin letter are told apart without the slow pattern.
    """
    lettered = (token >= "A") & (token < "{")
    return ~lettered & token.rlike(r"\A\p{Nd}*\z")


def drop_numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~is_numeric(w))


def drop_hash_signs(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.replace(w, F.lit("#"), F.lit("")))


def drop_non_ascii(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.regexp_replace(w, r"[^\x00-\x7F]", ""))


def drop_symbols(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]+", ""))


def clean_tokens(text: Column, stop_words: Sequence[str] = VECTOR_STOP_WORDS) -> Column:
    """The whole cleaning chain in one filter and one transform.

    Dropping ``#``, then non-ASCII, then non-alphanumerics leaves exactly the ASCII
    letters and digits, and the two placeholders lose their angle brackets.
    """
    words = list(stop_words)
    kept = F.filter(tokenize(text), lambda w: ~w.isin(words) & ~is_numeric(w))
    return F.transform(
        kept,
        lambda w: F.when(w.startswith("http"), "url")
        .when(w.startswith("@"), "username")
        .otherwise(ascii_alphanumerics(w)),
    )


ASCII_SYMBOLS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def ascii_alphanumerics(token: Column) -> Column:
    """Keep the ASCII letters and digits; the slow pattern runs on non-ASCII tokens only."""
    return let(
        F.translate(token, ASCII_SYMBOLS, ""),
        lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(
            F.regexp_replace(w, "[^a-zA-Z0-9]+", "")
        ),
    )


def clean_tokens_stepwise(text: Column, stop_words: Sequence[str] = VECTOR_STOP_WORDS) -> Column:
    """The same chain, one step per rule; the tests hold it equal to :func:`clean_tokens`."""
    tokens = drop_stop_words(tokenize(text), stop_words)
    for step in (mark_links, mark_mentions, drop_numbers, drop_hash_signs, drop_non_ascii,
                 drop_symbols):
        tokens = step(tokens)
    return tokens


# ---------------------------------------------------------------- n-grams

def ngrams(tokens: Column, n: int) -> Column:
    """Runs of exactly ``n`` tokens joined by a blank; empty when there are fewer tokens."""
    if n == 1:
        return tokens
    return let(
        tokens,
        lambda arr: F.when(
            F.size(arr) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(arr) - n),
                lambda i: F.concat_ws(" ", *[F.get(arr, i + k) for k in range(n)]),
            ),
        ).otherwise(no_strings()),
    )


def sub_sequences(tokens: Column, longest: int = 3) -> Column:
    """Every contiguous run of 1 to ``longest`` tokens."""
    return let(tokens, lambda arr: F.concat(*[ngrams(arr, n) for n in range(1, longest + 1)]))


def term_runs(tokens: Column) -> Column:
    """Count the tokens of one row: ``array<struct<term, tf>>`` in term order.

    Sorting inside the row and measuring runs needs no shuffle, unlike grouping
    exploded tokens by row.
    """

    def runs(sorted_tokens: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(sorted_tokens) - 1),
            lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)),
        )
        return let(
            firsts,
            lambda starts: F.transform(
                starts,
                lambda start, k: F.struct(
                    F.get(sorted_tokens, start).alias("term"),
                    (F.coalesce(F.get(starts, k + 1), F.size(sorted_tokens)) - start).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), lambda arr: F.when(F.size(arr) > 0, runs(arr)))


# ---------------------------------------------------------------- phrases and keywords

def prep_words(text: Column, stop_words: Sequence[str] = PHRASE_STOP_WORDS) -> Column:
    """Keyword form: ASCII only, no ``!``, lowercase, split on blanks, stop words out."""
    plain = F.replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), F.lit("!"), F.lit(""))
    return drop_stop_words(java_split(F.lower(plain)), stop_words)


def java_split(text: Column, pattern: str = " ") -> Column:
    """Split on a literal blank and drop the trailing empty pieces."""
    only_pattern = text.rlike(rf"\A(?:{pattern})+\z")
    return F.when(only_pattern, no_strings()).otherwise(
        F.split(F.rtrim(text, F.lit(pattern)), pattern)
    )


def phrase_words(text: Column, stop_words: Sequence[str] = PHRASE_STOP_WORDS) -> Column:
    """Lowercase words of a text without stop words, as matched against phrases."""
    return drop_stop_words(java_split(F.lower(text)), stop_words)


def phrase_key(text: Column, stop_words: Sequence[str] = PHRASE_STOP_WORDS) -> Column:
    """Dictionary form of a phrase."""
    return F.array_join(phrase_words(text, stop_words), " ")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def topic_of(text: Column, needle: str, topic: str, other: str) -> Column:
    """Route a text to ``topic`` when it holds ``needle`` in any case, else to ``other``."""
    return F.when(F.lower(text).contains(needle), topic).otherwise(other)
