"""Keyword and phrase linking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalink.functions.text import phrase_key, phrase_words, prep_words, sub_sequences, term_runs
from catalink.operators.joins import BROADCAST_ROWS, lookup_join, within
from catalink.session import landed
from catalink.operators.vectorize import hashed_bucket, hashed_idf, run_parts
from catalink.words import PHRASE_STOP_WORDS

# Bits of the filter for each phrase; powers of two of its bits at least and at most, and in a slice.
FILTER_BITS = 32
LEAST_POWER, MOST_POWER, SLICE_POWER = 16, 30, 20


def unique_words(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Words that occur exactly once across all phrases."""
    words = phrases.select(F.explode(prep_words(F.col(phrase))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("word")


def keyword_hits(posts: DataFrame, keywords: DataFrame, key: str = "post_id",
                 text: str = "text") -> DataFrame:
    """(post, n_hits): posts holding at least one keyword, with the number of distinct ones."""
    words = posts.select(
        key, F.explode(F.array_distinct(prep_words(F.col(text)))).alias("word"))
    hits = lookup_join(words, keywords.select("word").distinct(), "word", "left_semi")
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"))


def distinct_words(texts: DataFrame, words: str = "words") -> DataFrame:
    return texts.select(F.explode(words).alias("word")).distinct()


def phrase_dictionary(rows: DataFrame, fields: str = "fields", marker: str = "unfound",
                      shortest: int = 3) -> DataFrame:
    """Distinct phrases of rows without the ``marker`` field, long enough and no stop word."""
    phrases = rows.where(~F.array_contains(fields, marker)).select(
        F.explode(F.transform(fields, lambda f: phrase_key(f))).alias("phrase"))
    return phrases.where(
        (F.length("phrase") >= shortest) & ~F.col("phrase").isin(PHRASE_STOP_WORDS)
    ).distinct()


def written_phrases(phrases: DataFrame) -> DataFrame:
    """A dictionary written once for many calls of phrase_matches."""
    return landed(phrases.select("phrase").distinct(), "phrases")


def phrase_candidates(text: Column, longest: int = 3) -> Column:
    """Distinct word runs of a text that may equal a dictionary phrase."""
    return F.array_distinct(sub_sequences(phrase_words(text), longest))


def phrase_matches(posts: DataFrame, phrases: DataFrame, key: str = "post_id",
                   text: str = "text", longest: int = 3, written: bool = False,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(post, n_phrases): posts holding at least one dictionary phrase.

    ``written`` says that ``phrases`` is a written table of distinct phrases, as written_phrases
    gives; it is then used as it stands. Of a dictionary too large to broadcast, a filter is shipped
    first: only runs whose hash some phrase has are joined, which compares them exactly.
    """
    candidates = phrase_candidates(F.col(text), longest)
    known = phrases.select("phrase") if written else written_phrases(phrases)
    if within(known, broadcast_rows):
        # exploded as it stands: a column of its own would be worked out twice, for a filter on its size
        runs = posts.select(key, F.explode(candidates).alias("phrase"))
    else:
        runs = landed(_maybe_known(posts.select(key, candidates.alias("runs")), known), "runs").select(
            key, F.explode("runs").alias("phrase"))
    # each post has a phrase once
    hits = lookup_join(runs, known, "phrase", "left_semi", broadcast_rows, written=True, unique=True,
                       most_left=posts.count())
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_phrases"))


def _maybe_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with those of their ``runs`` whose hash some known phrase has: all that are known, and a
    few others.

    The filter has one bit for each hash: FILTER_BITS a phrase and 128 MB at most.
    """
    power = min(MOST_POWER, max(LEAST_POWER, (FILTER_BITS * known.count()).bit_length()))

    def slot(phrase: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(phrase), 64 - power)

    def bits(table: pa.Table) -> pa.Table:
        part = np.zeros(1 << min(power, SLICE_POWER), np.uint8)
        part[table["slot"].to_numpy() & (len(part) - 1)] = 1
        return pa.table({"part": table["part"][:1],
                         "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    slots = known.select(slot(F.col("phrase")).alias("slot")).select(
        F.shiftright("slot", SLICE_POWER).cast("int").alias("part"), "slot")
    held = np.zeros(1 << power - 3, np.uint8)
    width = len(held) >> max(0, power - SLICE_POWER)
    for row in slots.groupBy("part").applyInArrow(bits, "part int, bits binary").toLocalIterator():
        held[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("array<int>")
    def places(slots: pa.Array) -> pa.Array:
        lengths = slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = slots.flatten().to_numpy(zero_copy_only=False)
        begin = np.cumsum(lengths) - lengths
        hit = np.flatnonzero(shipped.value[flat >> 3] >> (flat & 7).astype(np.uint8) & 1)
        row = np.searchsorted(begin + lengths, hit, side="right")
        counts = np.bincount(row, minlength=len(lengths))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((hit - begin[row]).astype(np.int32)))

    found = rows.withColumn("places", places(F.transform("runs", slot)))
    return found.withColumn("runs", F.transform("places", lambda i: F.get("runs", i))).drop("places")


def post_keywords(posts: DataFrame, key: str = "post_id", tokens: str = "tokens",
                  fraction: float = 0.2, buckets: int = 1 << 20) -> DataFrame:
    """(post, term, copies): the ``fraction`` of a post's tokens with the highest TF-IDF.

    Weights are hashed, so at most ``buckets`` frequencies are shipped. A token that
    occurs several times counts once per occurrence; ties go to the smaller term. Rows of one post
    are taken together. A post's terms travel in one row; tasks pick from them.
    """
    counted = F.transform(term_runs(F.col(tokens)), lambda r: F.struct(
        r["term"].alias("term"), r["tf"].cast("long").alias("tf"),
        hashed_bucket(r["term"], buckets).alias("bucket")))
    rows = posts.select(key, F.struct(F.size(tokens).alias("n_tokens"), counted.alias("runs")).alias("row"))
    rows = rows.groupBy(key).agg(F.collect_list("row").alias("rows")).select(key, F.flatten(F.transform(
        "rows", lambda row: F.transform(row["runs"], lambda r: F.struct(
            r["term"].alias("term"), r["tf"].alias("tf"), r["bucket"].alias("bucket"),
            row["n_tokens"].alias("n_tokens"))))).alias("runs"))
    idf = np.zeros(buckets)
    found = hashed_idf(posts, tokens, buckets).toArrow()
    idf[found["bucket"].to_numpy()] = found["idf"].to_numpy()
    shipped = posts.sparkSession.sparkContext.broadcast(idf)
    schema = T.StructType([posts.schema[key], T.StructField("term", T.StringType()),
                           T.StructField("copies", T.LongType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run_parts(batches):
            runs = batch.column("runs")
            lengths = pc.fill_null(runs.value_lengths(), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(runs)), lengths)
            runs = runs.flatten()
            tf, bucket, n_tokens = (runs.field(i).to_numpy() for i in (1, 2, 3))
            _, own = np.unique(row * np.int64(buckets) + bucket, return_inverse=True)
            weight = np.round(np.bincount(own, weights=tf)[own] * shipped.value[bucket], 9)
            coded = runs.field(0).dictionary_encode()
            place = np.empty(len(coded.dictionary), np.int64)
            place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
            order = np.lexsort((place[coded.indices.to_numpy()], -weight, row))
            tf, row = tf[order], row[order]
            before = np.cumsum(tf) - tf
            before -= before[np.searchsorted(row, row)]
            budget = np.floor(n_tokens[order] * fraction).astype(np.int64)
            copies = np.minimum(tf, budget - before)
            kept = np.flatnonzero(copies > 0)
            yield pa.record_batch([
                batch.column(key).take(pa.array(row[kept])),
                runs.field(0).take(pa.array(order[kept])), pa.array(copies[kept])], schema.names)

    return rows.mapInArrow(pick, schema)


def token_app_matches(keywords: DataFrame, apps: DataFrame, key: str = "post_id",
                      app_key: str = "app_id", words: str = "words") -> DataFrame:
    """(post, term, app): apps holding a post keyword in any case.

    A keyword counts only when some app holds it in exactly the same case.
    """
    app_words = apps.select(app_key, F.explode(F.array_distinct(words)).alias("word"))
    vocabulary = app_words.select(F.col("word").alias("term")).distinct()
    known = lookup_join(keywords.select(key, "term").distinct(), vocabulary, "term", "left_semi")
    folded = app_words.select(app_key, F.lower("word").alias("folded")).distinct()
    return lookup_join(
        known.withColumn("folded", F.lower("term")), folded, "folded"
    ).select(key, "term", app_key)
