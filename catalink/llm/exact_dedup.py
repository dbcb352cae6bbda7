"""Exact duplicates: frequent digests are settled on the map side, the rest by one shuffle.

A Misra-Gries summary (Spark's frequent-items aggregate) names candidates for frequent digests.
Their groups are then counted exactly, and the verified winners, at most REPORTED rows, are
broadcast: rows of a hot group never meet in one task. All other rows are shuffled by digest,
without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalink.llm.textbytes import named, unused
from catalink.session import landed

#: Counters of the summary in each task: a text in more than 1/TRACKED of the rows is found.
TRACKED = 4096
#: Candidates verified and broadcast at most; a bound on the broadcast, not on the result.
REPORTED = 1024


def digest(text: str | Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as the empty text."""
    text = named(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def frequent_digests(keyed: DataFrame) -> DataFrame:
    """Verified groups among the most frequent digests: digest, keep_id, keep_row, group_size.

    The row that stays is that of the largest id, of several such the one of the largest number.
    """
    found = keyed.select(F.hex("digest").alias("item")).agg(
        F.expr(f"approx_top_k(item, {REPORTED}, {TRACKED})").alias("top"))
    candidates = found.select(F.explode("top.item").alias("item")).select(
        F.unhex("item").alias("digest"))
    return (keyed.join(F.broadcast(candidates), "digest", "left_semi")
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1")
            .select("digest", F.col("keep.doc_id").alias("keep_id"),
                    F.col("keep.row").alias("keep_row"), "group_size"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null equals the empty text. The row with the largest id stays
    (null ids come last; keep_id is null only if every id of the group is). Of rows that repeat
    both id and text exactly one is kept. Empty texts are texts like any other, very long ones are
    digested whole. Other columns of `docs` are ignored, whatever their names; an empty table gives
    an empty result.
    """
    keyed = landed(docs.select(named(id_col).alias("doc_id"), digest(text_col).alias("digest"))
                   .withColumn("row", F.monotonically_increasing_id()), "digests")
    winners = landed(frequent_digests(keyed), "frequent")
    hot = (keyed.join(F.broadcast(winners), "digest")
           .withColumn("kept", F.col("row") == F.col("keep_row")).drop("keep_row"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("doc_id").desc_nulls_last())
    rest = (keyed.join(F.broadcast(winners), "digest", "left_anti")
            .withColumn("kept", F.row_number().over(order) == 1)
            .withColumn("keep_id", F.max("doc_id").over(group))
            .withColumn("group_size", F.count(F.lit(1)).over(group)))
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    One row of each text stays, as exact_copies tells; null and the empty text are one text, of rows
    that repeat id and text one stays. Columns may have any names; an empty table stays empty.
    """
    own, key = unused("kept_id", docs), unused("kept_digest", docs)
    verdicts = landed(exact_copies(docs, id_col, text_col), "verdicts")
    stays = verdicts.filter("kept").select(
        F.col("doc_id").alias(own), F.unhex("text_sha256").alias(key))
    same = [named(id_col).eqNullSafe(F.col(own)), digest(text_col) == F.col(key)]
    left = docs.join(stays, same, "left_semi")
    # rows that repeat both id and text: rare, so only they are brought together
    repeats = landed(verdicts.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(
        F.col("doc_id").alias(own), F.unhex("text_sha256").alias(key)), "repeats")
    if repeats.isEmpty():
        return left
    again = left.join(repeats, same, "left_semi").withColumn(key, digest(text_col))
    return left.join(repeats, same, "left_anti").unionByName(
        again.dropDuplicates([id_col, key]).drop(key))
