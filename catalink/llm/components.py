"""Connected components of a link table, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.session import landed


def components(links: DataFrame) -> DataFrame:
    """node, root for every end of a link (columns a, b of one ordered type); root: least node.

    Large and small stars in turn until the stars stay as they are. Minima are combined before
    they are shuffled and written before they are joined, so Spark can split the join of a node in
    very many links. Every round is written, so lost executors cost one round at most. Links of a
    node to itself and repeated links do no harm; without links the result is empty.
    """
    stars = landed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a != b").distinct(), "links")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = landed(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = landed(both.join(least, "a").filter("b > a")
                       .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
                       .filter("a != b").distinct(), "large")
        least = landed(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b")))
                 .filter("a != b").distinct())
        stars = landed(small, "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
