"""Importance resampling towards a target set, over hashed features.

Features are runs of words. A task takes the distinct features of a slice of documents, groups them
by length into two-dimensional byte arrays, and moves the CRC of all rows of an array on by one column
at a time; the buckets are then scattered back to every place a feature stands. Only counts by bucket
leave the tasks, summed on the map side, and only gains by bucket go back to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.pretokens import shared
from catalink.llm.textbytes import LOWER, byte_slices, id_and_bytes, joined, named, stretches
from catalink.operators.ordered import ranked
from catalink.session import landed

#: Columns of an array; a longer feature takes several rows, whose sums are put together after.
WIDTH = 64
#: Cells of the arrays updated together.
CELLS = 4 << 20
_POLYNOMIAL, _ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)

#: Bytes that are no part of a word: the controls, blanks and signs of ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[128:] = BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = False


def _table() -> np.ndarray:
    """What a byte does to a CRC-32, worked out bit by bit for all bytes at once."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_TABLE = _table()


def _moved(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """CRC states after the columns of a byte array."""
    for column in columns.T:
        crc = _TABLE[(crc & 0xFF) ^ column] ^ (crc >> 8)
    return crc


def _over_zeros() -> np.ndarray:
    """By byte of a state, what WIDTH zero bytes make of it; the parts of a state add up by xor."""
    parts = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return _moved(parts.ravel(), np.zeros((1024, WIDTH), np.uint8)).reshape(4, 256)


_ZEROS = _over_zeros()


def crc32_rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of a byte array, those of equal length together."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    short = lengths[order]
    edges = np.flatnonzero(np.diff(short, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        length = int(short[lo])
        whole, head = divmod(length, WIDTH)
        step = max(1, CELLS // max(1, min(length, WIDTH)))
        for at in range(lo, hi, step):
            rows = order[at:min(hi, at + step)]
            begin = starts[rows]
            crc = _moved(np.full(len(rows), _ONES), data[begin[:, None] + np.arange(head)])
            for k in range(whole):
                block = data[begin[:, None] + np.arange(head + k * WIDTH, head + (k + 1) * WIDTH)]
                own = _moved(np.zeros(len(rows), np.uint32), block)
                crc = own ^ np.bitwise_xor.reduce(
                    [_ZEROS[i][(crc >> (8 * i)) & 0xFF] for i in range(4)])
            out[rows] = crc ^ _ONES
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a few texts with A to Z lowered, begins and ends of their words, text of each."""
    data, bounds = joined(texts)
    n = len(data)
    inside = ~BETWEEN[data]
    border = np.zeros(n + 1, bool)  # a word ends where its text ends
    border[bounds] = True
    border[:-1] |= ~inside
    border[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    begins = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & border[1:]) + 1
    return LOWER[data], begins, ends, np.searchsorted(bounds, begins, side="right") - 1


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, owner: np.ndarray,
         most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to `most`: the bytes, and start, length and text of every run of words.

    The bytes hold the words with one space after each, so every run is one stretch of them.
    """
    lengths = ends - begins
    at = np.cumsum(lengths + 1) - (lengths + 1)
    spaced = np.full(int((lengths + 1).sum()), 32, np.uint8)
    place = np.ones(len(spaced), bool)
    place[at + lengths] = False
    spaced[place] = stretches(data, begins, ends)
    for k in range(1, most + 1):
        first = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:]) if len(owner) >= k else []
        first = np.asarray(first, np.int64)
        last = first + k - 1
        yield spaced, at[first], at[last] + lengths[last] - at[first], owner[first]


def buckets_of(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of words of every text."""
    data, begins, ends, owner = words_of(texts)
    owners, found = [], []
    for spaced, starts, lengths, own in runs(data, begins, ends, owner, most):
        total, at = np.cumsum(lengths), 0
        while at < len(starts):
            done = int(total[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(total, done + CELLS, side="right")))
            found.append(_distinct_buckets(spaced, starts[at:upto], lengths[at:upto], buckets))
            owners.append(own[at:upto])
            at = upto
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found or [empty]), np.concatenate(owners or [empty]),
            np.bincount(owner, minlength=len(texts)))


def _distinct_buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                      buckets: int) -> np.ndarray:
    """Bucket of each stretch; every distinct one is hashed once."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    copied = data[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])]
    features = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(bounds), pa.py_buffer(copied)]).dictionary_encode()
    distinct = features.dictionary
    edges = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
    held = np.frombuffer(distinct.buffers()[2], np.uint8)
    crc = crc32_rows(held, edges[:-1], np.diff(edges))
    return (crc % np.uint32(buckets)).astype(np.int64)[features.indices.to_numpy()]


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts; at most `buckets` rows a task and in the driver."""
    rows = id_and_bytes(texts.select(F.lit(0).alias("none"), named(text_col).alias("own")),
                        "none", "own").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in byte_slices(batches):
            bucket, _, _ = buckets_of(part.column("text"), most, buckets)
            total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    sums = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share in the corpus."""
    n, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n))))
        for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of all features of a text."""
    rows = id_and_bytes(docs, id_col, text_col)
    held = shared(docs.sparkSession, gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            n, worth = part.num_rows, held.value
            bucket, owner, words = buckets_of(part.column("text"), most, len(worth))
            # whole numbers far below 2^53, so their sums as doubles are exact
            weight = np.bincount(owner, weights=worth[bucket], minlength=n).astype(np.int64)
            yield pa.record_batch([
                part.column("doc_id"), pa.array(words.astype(np.int64)),
                pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id {}, n_words long, n_features long, weight long".format(
        rows.schema["doc_id"].dataType.simpleString()))


def noise(seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from the digest of the seed and its id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10,
             least: int = 20, seed: int = 2024) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to `most` words. Of the documents with at least `least` words,
    `percent` in 100 are drawn without replacement: those with the highest scores, weight plus noise,
    ties to the smaller id (null last). `rank` counts the drawn from 1 and is null for all others.
    Null and empty texts have no features and weight 0; rows that repeat an id share its noise and
    are ranked one after the other; a null id counts as an empty one for its noise. A very long text
    is taken alone, its features in bounded arrays. Other columns are ignored, whatever their names;
    an empty table gives an empty result, an empty target ranks by rarity alone.
    """
    gain = gains(bucket_counts(docs, text_col, most, buckets),
                 bucket_counts(target, target_text, most, buckets))
    scored = landed(weighed(docs, gain, most, id_col, text_col)
                    .withColumn("score", F.col("weight") + noise(seed))
                    .withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    place = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked(able, order, "place").withColumn("rank", place).unionByName(
        scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")),
        allowMissingColumns=True).select("doc_id", "n_features", "weight", "score", "rank")
