"""Joins whose left key may be skewed, membership tests and set operations on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalink.functions.ids import row_key
from catalink.session import landed

# A right side within both bounds is broadcast; its rows and bytes are measured first.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 100_000_000
# At most this many left keys can be called hot, because each holds 1/HOT_KEYS of the rows.
HOT_KEYS = 20_000
# A key is never split for fewer rows than this.
ROWS_PER_SALT = 1_000_000


def within(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, a written table, has at most ``rows`` rows and ``size`` bytes as text.

    Rows are counted first, from the files' own counts; only a table within that bound is measured,
    by sums over its parts.
    """
    if df.count() > rows:
        return False
    text = F.octet_length(F.to_json(F.struct("*")))
    return df.agg(F.coalesce(F.sum(text), F.lit(0))).first()[0] <= size


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                broadcast_rows: int = BROADCAST_ROWS, rows_per_salt: int = ROWS_PER_SALT,
                written: bool = False, unique: bool = False,
                most_left: int | None = None) -> DataFrame:
    """Join on ``key`` where any key may hold a large share of the rows, on either side.

    The right side is written, so it is computed once, unless the caller says that it is
    ``written`` already. A small one is broadcast after its size was checked. Otherwise the keys of both sides
    are counted (combined on the map side) and each hot key is split into a grid of tasks: a left
    row takes one of its left salts and is copied to all right ones, a right row the other way
    round. Works for inner, left, left_semi and left_anti joins; only an inner join may copy
    left rows, semi and anti joins need each right key once, and a left join leaves its right
    rows whole. Sides are not counted where the caller knows that right keys are ``unique`` and that
    no left key has more than ``most_left`` rows, too few to be split.
    """
    if not written:
        right = landed(right, "lookup")
    if within(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    if unique and most_left is not None and most_left <= rows_per_salt:
        return left.join(right, key, how)
    if how in ("left_semi", "left_anti"):
        right = right.select(key).distinct()
    left_salts = _salts(left, key, "left_salts", rows_per_salt)
    spread_left = left.join(left_salts, key, "left").withColumn(
        "salt", _salt_of(left, F.col("left_salts")))
    copies = right.join(left_salts, key, "left").withColumn("salt", _all(F.col("left_salts")))
    on = [key, "salt"]
    if how == "inner":
        right_salts = _salts(right, key, "right_salts", rows_per_salt)
        spread_left = spread_left.join(right_salts, key, "left").withColumn(
            "part", _all(F.col("right_salts"))).drop("right_salts")
        copies = copies.join(right_salts, key, "left").withColumn(
            "part", _salt_of(right, F.col("right_salts"))).drop("right_salts")
        on.append("part")
    return spread_left.drop("left_salts").join(
        copies.drop("left_salts"), on, how).drop("salt", "part")


def _salts(side: DataFrame, key: str, out: str, rows_per_salt: int) -> DataFrame:
    """(key, number of salts) of the hot keys of one side: at most HOT_KEYS rows, broadcast."""
    counts = landed(side.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(rows_per_salt, -(-total // HOT_KEYS))
    return F.broadcast(counts.where(F.col("n") > share).select(
        key, F.ceil(F.col("n") / share).cast("int").alias(out)))


def _salt_of(side: DataFrame, salts: Column) -> Column:
    return F.pmod(row_key(F.struct(*side.columns)), F.coalesce(salts, F.lit(1))).cast("int")


def _all(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))


def exists_in(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each id with whether ``table`` holds it: one left join instead of one job per id."""
    present = table.select(key).distinct().withColumn("present", F.lit(True))
    return ids.join(present, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def minus_seen(catalogue: DataFrame, seen: dict[str, DataFrame]) -> DataFrame:
    """Catalogue rows whose value is unseen in every column; one anti join per column."""
    for column, values in seen.items():
        catalogue = lookup_join(catalogue, values.select(column).distinct(), column, "left_anti")
    return catalogue


def seen_counts(catalogue: DataFrame, seen: dict[str, DataFrame]) -> DataFrame:
    """(column, n): how many catalogue rows each list of seen values already covers."""
    parts = [
        lookup_join(catalogue, values.select(column).distinct(), column, "left_semi")
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("seen_by"), "n")
        for column, values in seen.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def two_sided(corpus: DataFrame, key: str, side: str = "side") -> DataFrame:
    """Rows whose key occurs on both sides of the corpus.

    The sides of a key are counted with a map-side combine, so a key with many rows on one
    side sends one row per task.
    """
    both = corpus.groupBy(key).agg(F.count_distinct(side).alias("sides")).where("sides = 2")
    return lookup_join(corpus, both.select(key), key, "left_semi")


def insert_ignore(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``existing`` nor seen twice.

    Of several new rows with one key the one with the smallest values stays, so a retried
    write inserts the same rows.
    """
    columns = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select(key, "row.*")
    return once.join(existing.select(key).distinct(), key, "left_anti").select(new.columns)
