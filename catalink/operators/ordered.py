"""Numbers and running sums in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalink.session import landed


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Dense 0-based numbers in the given order, beside all columns."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {out: "__one"}).withColumn(
        out, F.col(out) - 1).drop("__one")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums of columns in the given order, which must tell all rows apart.

    A written, range-partitioned table keeps the ranges fixed between the two passes that
    add them up: once as a whole, once row by row.
    """
    ranges = landed(
        df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    whole = ranges.groupBy("__range").agg(*[F.sum(c).alias(f"__{o}") for o, c in sums.items()])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("__range", *[
        F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return ranges.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()}).join(
        F.broadcast(offsets), "__range").select(  # one row per shuffle partition
        *df.columns, *[(F.col(o) + F.col(f"__{o}")).cast("long").alias(o) for o in sums])
