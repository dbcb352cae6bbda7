"""Contiguous shards of near equal bytes: the smallest capacity for which greedy cuts suffice.

Groups of equal texts are atomic. They are ordered by digest, which mixes languages and sources,
and cut into contiguous shards so that the largest shard is as small as it can be. The capacity is
found by binary search with a greedy check. The driver never sees all groups: it holds weights of
digest prefixes, and only the few prefixes in which a cut falls are resolved further, until every
cut lies between two groups. The result is the exact optimum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalink.session import landed

#: Hex digits of the first prefixes (at most 65,536 of them) and of each further step.
FIRST, STEP = 4, 2
#: Prefixes resolved on either side of one in which a cut falls, to save rounds.
BESIDE = 2
#: Rows numbered together.
NUMBERED = 1024


@dataclass
class Segments:
    """Weights of digest prefixes in digest order; one that holds a single group is atomic."""

    prefix: np.ndarray
    weight: np.ndarray
    groups: np.ndarray

    def replaced(self, gone: np.ndarray, by: Segments) -> Segments:
        parts = [np.concatenate([getattr(self, k)[~gone], getattr(by, k)])
                 for k in ("prefix", "weight", "groups")]
        order = np.argsort(parts[0])
        return Segments(*(x[order] for x in parts))


def weigh(groups: DataFrame, digits: int) -> Segments:
    """Segments of the prefixes with so many digits; groups: digest, weight."""
    rows = (groups.groupBy(F.substring("digest", 1, digits).alias("prefix"))
            .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("groups"))
            .orderBy("prefix").collect())
    return Segments(np.array([r.prefix for r in rows], dtype="U64"),
                    np.array([r.weight for r in rows], dtype=np.int64),
                    np.array([r.groups for r in rows], dtype=np.int64))


def greedy(s: Segments, capacity: int, shards: int) -> tuple[list[int], bool, set[int]]:
    """Fill shard after shard: first segment of each next shard, whether all fits, open cuts.

    A segment of several groups may be cut anywhere for now; such a cut is open.
    """
    ends = np.cumsum(s.weight)
    total, at, cuts, open_cuts = int(ends[-1]), 0, [], set()
    for _ in range(shards):
        if at + capacity >= total:
            return cuts, True, open_cuts
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        edge = int(ends[i - 1]) if i else 0
        if s.groups[i] > 1 and at + capacity > edge:
            open_cuts.add(i)
            at += capacity
        else:
            at = edge
        cuts.append(i)
    return cuts, False, open_cuts


def smallest_capacity(s: Segments, shards: int, least: int) -> int:
    low, high = max(least, -(-int(s.weight.sum()) // shards)), int(s.weight.sum())
    while low < high:
        middle = (low + high) // 2
        if greedy(s, middle, shards)[1]:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digest prefixes at which the second and later shards begin, and the capacity."""
    segments = weigh(groups, FIRST)
    if not len(segments.weight):
        return [], 0
    least = groups.agg(F.max("weight")).first()[0]
    while True:
        capacity = smallest_capacity(segments, shards, least)
        cuts, _, open_cuts = greedy(segments, capacity, shards)
        if not open_cuts:
            return [str(segments.prefix[i]) for i in cuts], capacity
        near = {j for i in open_cuts for j in range(i - BESIDE, i + BESIDE + 1)
                if 0 <= j < len(segments.prefix) and segments.groups[j] > 1}
        by_length: dict[int, list[str]] = {}
        for j in near:
            by_length.setdefault(len(segments.prefix[j]), []).append(str(segments.prefix[j]))
        finer = [weigh(groups.filter(F.substring("digest", 1, n).isin(found)), n + STEP)
                 for n, found in sorted(by_length.items())]
        gone = np.zeros(len(segments.prefix), dtype=bool)
        gone[list(near)] = True
        segments = segments.replaced(gone, Segments(
            *(np.concatenate([getattr(x, k) for x in finer]) for k in ("prefix", "weight", "groups"))))


def shard_of(digest: Column, cuts: list[str]) -> Column:
    return sum((F.when(digest >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")


def contiguous_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: equal texts stay together, and the largest shard is as small as any contiguous
    cut of the groups allows. size: UTF-8 bytes plus 1; null counts as the empty text. slot: a
    gapless number from 0 in the shard, in an order mixed by id. Rows that repeat an id get slots
    of their own. Fewer groups than shards leave the last shards empty. Other columns of `docs` are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = landed(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest")), "sizes")
    groups = landed(keyed.groupBy("digest").agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "groups")
    cuts, _ = minimax_cuts(groups, shards)
    rows = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, rows // (shards * NUMBERED))
    placed = keyed.withColumn("shard", shard_of(F.col("digest"), cuts)).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (placed.withColumn("own", F.row_number().over(own)).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("own") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
