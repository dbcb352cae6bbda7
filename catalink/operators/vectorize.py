"""Term weights: vocabulary fitting, count / binary / TF-IDF weights, hashed weights.

A vocabulary holds every term that occurs in at least ``min_df`` rows; nothing is cut off. It is
counted with a map-side combine, numbered over key ranges and written once. Weighting joins it
on the term: a broadcast where its measured size allows, a join with salted hot terms beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from catalink.functions.text import clean_tokens, ngrams, term_runs
from catalink.functions.stem import stem_tokens
from catalink.operators.joins import BROADCAST_ROWS, lookup_join, within
from catalink.operators.ordered import ranked
from catalink.session import bucketed as in_hash_buckets, landed

# Counted terms of rows worked on together in a task, unless a row has more of them.
PART_TERMS = 500_000
FORMS = ("count", "binary", "tfidf")


def with_terms(df: DataFrame, text: str = "text", n: int = 1, stem: bool = False,
               out: str = "terms") -> DataFrame:
    """Clean, optionally stem, and cut a text column into terms; replaces the text column."""
    tokens = clean_tokens(F.col(text))
    if stem:
        tokens = stem_tokens(tokens)
    return df.withColumn(out, ngrams(tokens, n)).drop(text)


def exploded_runs(df: DataFrame, terms: str = "terms") -> DataFrame:
    """One row per (row, distinct term) with its count; every other column is carried."""
    carried = [c for c in df.columns if c != terms]
    return df.select(*carried, F.inline(term_runs(F.col(terms))))


def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches with about PART_TERMS terms each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("runs")), 0).to_numpy(
            zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + PART_TERMS, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


@dataclass(frozen=True)
class TermModel:
    """A fitted vocabulary: ``terms`` holds (term, doc_freq, corpus_count, idf) of every term."""

    terms: DataFrame
    size: int
    n_docs: int
    form: str

    @cached_property
    def vocabulary(self) -> DataFrame:
        """The terms with their numbers ``idx``, which are worked out when first asked for."""
        return landed(ranked_terms(self.terms), "vocabulary")

    @cached_property
    def entries(self) -> pa.Table:
        """The vocabulary as fetched, for operators that checked ``size`` before they ship it."""
        return self.vocabulary.select("term", "idx", "idf").toArrow()

    def with_form(self, form: str) -> TermModel:
        """The same vocabulary, numbered and fetched once, for another form of weights."""
        other = replace(self, form=form)
        other.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("vocabulary", "entries")})
        return other

    def weight(self) -> Column:
        return weight_of(self.form)

    def weights(self, df: DataFrame, terms: str = "terms") -> DataFrame:
        """Long form: the carried columns plus (term, idx, doc_freq, weight)."""
        known = self.vocabulary.select("term", "idx", "doc_freq", "idf")
        return self._known(df, terms, known).drop("tf", "idf")

    def unranked_weights(self, df: DataFrame, terms: str = "terms") -> DataFrame:
        """The same without an order of the numbers: ``idx`` only tells terms apart, within one table
        that this is written to. No vocabulary is sorted and written for it."""
        known = self.terms.select("term", "doc_freq", "idf").withColumn(
            "idx", F.monotonically_increasing_id())
        return self._known(df, terms, known).drop("tf", "idf")

    def term_weights(self, df: DataFrame, terms: str = "terms") -> DataFrame:
        """The same with the terms themselves only: the carried columns plus (term, idf, weight)."""
        return self._known(df, terms, self.terms.select("term", "idf")).drop("tf")

    def of_runs(self, runs: DataFrame, most_left: int) -> DataFrame:
        """term_weights of rows (term, tf, ...) in which a term stands ``most_left`` times at most."""
        return lookup_join(runs, self.terms.select("term", "idf"), "term", written=True, unique=True,
                           most_left=most_left).withColumn("weight", self.weight()).drop("tf")

    def restricted(self, runs: DataFrame) -> TermModel:
        """The model with the terms of these rows only, where they are few enough to be broadcast;
        the whole vocabulary is then filtered where it lies."""
        wanted = landed(runs.select("term").distinct(), "wanted-terms")
        if not within(wanted, BROADCAST_ROWS):
            return self
        return replace(self, terms=landed(
            self.terms.join(F.broadcast(wanted), "term", "left_semi"), "terms"))

    def _known(self, df: DataFrame, terms: str, known: DataFrame) -> DataFrame:
        # a term stands in one row for each text that has it
        return lookup_join(exploded_runs(df, terms), known, "term", written=True, unique=True,
                           most_left=df.count()).withColumn("weight", self.weight())


def count_weights(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Long counts (term, weight) of all terms, which need no vocabulary: each row tells its own."""
    return exploded_runs(df, terms).withColumn("weight", weight_of("count")).drop("tf")


def weight_of(form: str, threshold: float = 0.99) -> Column:
    if form == "count":
        return F.col("tf").cast("double")
    if form == "binary":
        return binarized(F.col("tf").cast("double"), threshold)
    if form == "tfidf":
        return F.col("tf") * F.col("idf")
    raise ValueError(f"unknown weight form: {form}")


def binarized(value: Column, threshold: float = 0.99) -> Column:
    """1 where the value is strictly above the threshold, else 0."""
    return F.when(value > threshold, 1.0).otherwise(0.0)


def term_statistics(df: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, doc_freq, corpus_count) over the corpus."""
    return exploded_runs(df.select(terms), terms).groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("corpus_count")
    )


def ranked_terms(stats: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """Terms numbered by falling corpus count, ties by term, as ``idx``; all or the first few."""
    order = _by_count()
    kept = stats if vocab_size is None else stats.orderBy(*order).limit(vocab_size)
    return ranked(kept, order, "idx").withColumn("idx", F.col("idx").cast("int"))


def _by_count() -> list[Column]:
    return [F.desc("corpus_count"), F.asc("term")]


def fit_terms(df: DataFrame, terms: str = "terms", form: str = "tfidf", min_df: int = 1,
              vocab_size: int | None = None, n_docs: int | None = None,
              in_buckets: bool = False) -> TermModel:
    """Fit a vocabulary over every row of ``df``: all terms with ``doc_freq >= min_df``.

    ``vocab_size`` keeps only so many of the most frequent; no cut is made unless it is asked for.
    Terms written ``in_buckets``, which they are counted in, are joined without a shuffle of theirs.
    """
    if form not in FORMS:
        raise ValueError(f"unknown weight form: {form}")
    n_docs = df.count() if n_docs is None else n_docs
    idf = F.log((F.lit(n_docs) + 1.0) / (F.col("doc_freq") + 1.0))
    stats = term_statistics(df, terms).where(F.col("doc_freq") >= min_df).withColumn("idf", idf)
    if vocab_size is not None:
        stats = stats.orderBy(*_by_count()).limit(vocab_size)
    if in_buckets:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stats = in_hash_buckets(stats, "terms", "term", buckets)
    else:
        stats = landed(stats, "terms")
    return TermModel(stats, stats.count(), n_docs, form)


def hashed_bucket(term: Column, buckets: int) -> Column:
    """Bucket of a term, from its MD5 digest so any engine can reproduce it."""
    head = F.conv(F.substring(F.md5(term.cast("binary")), 1, 7), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets)).cast("int")


def hashed_tfidf(df: DataFrame, key: str, tokens: str, buckets: int = 1 << 20) -> DataFrame:
    """TF-IDF per hash bucket: (key, bucket, weight). At most ``buckets`` rows are broadcast."""
    per_bucket = exploded_runs(df.select(key, bucketed(F.col(tokens), buckets).alias("terms")))
    idf = hashed_idf(df, tokens, buckets)
    return per_bucket.withColumnRenamed("term", "bucket").join(F.broadcast(idf), "bucket").select(
        key, "bucket", (F.col("tf") * F.col("idf")).alias("weight")
    )


def bucketed(tokens: Column, buckets: int) -> Column:
    return F.transform(tokens, lambda t: hashed_bucket(t, buckets))


def hashed_idf(df: DataFrame, tokens: str, buckets: int) -> DataFrame:
    """(bucket, idf), at most ``buckets`` rows; a row counts once per bucket it touches."""
    n_docs = df.count()
    kinds = bucketed(F.array_distinct(tokens), buckets)
    touched = df.select(F.explode(F.array_distinct(kinds)).alias("bucket"))
    return touched.groupBy("bucket").agg(
        F.log((F.lit(n_docs) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("idf")
    )


def word_positions(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, position, word_id): each word replaced by its number in the sorted dictionary.

    Numbers come from a range-partitioned sort: rows are numbered inside each range and
    shifted by the sizes of the ranges before it, so no task sees the whole dictionary.
    """
    words = df.select(F.explode(F.array_distinct(tokens)).alias("word")).distinct()
    numbered = number_rows(words, "word", "word_id")
    positions = df.select(key, F.posexplode(tokens).alias("position", "word"))
    return lookup_join(positions, numbered, "word").select(key, "position", "word_id")


def number_rows(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense 0-based numbers in key order for unique keys, without a single-task window."""
    return ranked(df.select(key), [F.asc(key)], out)


def packed(weights: DataFrame, key: str) -> DataFrame:
    """Long weights regrouped to one row per key: (key, idx array, weight array) in idx order."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    return weights.groupBy(key).agg(entries.alias("entries")).select(
        key, F.col("entries.idx").alias("idx"), F.col("entries.weight").alias("weight")
    )


def numbered_keys(df: DataFrame, key: str, out: str) -> DataFrame:
    """An int id per key for factorisation: dense row numbers in key order."""
    return number_rows(df.select(key).distinct(), key, out).withColumn(out, F.col(out).cast("int"))
