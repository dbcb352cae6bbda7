"""Folds by the checksum of a document's id, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def spread_sample(rows: DataFrame, key: list[str], of: Column, most: int) -> DataFrame:
    """About `most` of `of` rows, picked by a hash of the key columns; never over twice as many."""
    pick = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.greatest(of, F.lit(1)))
    return rows.filter(pick < most).limit(2 * most)
