"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2^31 - 1


def app_id_from_url(url: Column) -> Column:
    """Text after the first ``=`` up to the next ``&``; the whole start when there is no ``=``."""
    tail = F.when(
        F.instr(url, "=") > 0, F.substring(url, F.instr(url, "=") + 1, F.length(url))
    ).otherwise(url)
    return F.substring_index(tail, "&", 1)


def app_id_from_query(url: Column, key: str = "id") -> Column:
    """Strict form: the value of one query parameter, null when absent or unparsable."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def app_id_from_apk(name: Column) -> Column:
    """Text before the first ``-``, empty when there is none."""
    return F.when(F.instr(name, "-") > 0, F.substring_index(name, "-", 1)).otherwise("")


def app_id_from_entities(entities: Column) -> Column:
    """App id of the first linked URL of a post."""
    return app_id_from_url(F.get(entities, F.lit(0))["expandedURL"])


def base_name(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def seeded_key(key: Column, seed: int) -> Column:
    """A pseudo-random number in [0, 2^31-1) from an integer key, the same in any SQL engine."""
    first = F.pmod(F.pmod(key.cast("long"), F.lit(PRIME)) * 48271 + seed * 7919 + 11, F.lit(PRIME))
    mixed = F.pmod(first * 69621 + F.floor(first / 65536), F.lit(PRIME))
    return F.pmod(mixed * 16807 + seed, F.lit(PRIME)).cast("long")


def seeded_key_sql(key: str, seed: int) -> str:
    """The same number as a SQL expression (``%`` on non-negative values)."""
    first = f"((({key}) % {PRIME}) * 48271 + {seed * 7919 + 11}) % {PRIME}"
    mixed = f"(({first}) * 69621 + ({first}) // 65536) % {PRIME}"
    return f"((({mixed}) * 16807 + {seed}) % {PRIME})"


def row_key(column: Column) -> Column:
    """A non-negative integer key for any id type."""
    return F.pmod(F.xxhash64(column), F.lit(PRIME))


def fold_of(key: Column, folds: int = 5, seed: int = 412) -> Column:
    """Fold number of an integer key, from the high bits of its pseudo-random number."""
    return F.pmod(F.floor(seeded_key(key, seed) / 1024), F.lit(folds)).cast("int")


def fold_sql(key: str, folds: int = 5, seed: int = 412) -> str:
    return f"CAST(({seeded_key_sql(key, seed)} // 1024) % {folds} AS INTEGER)"
