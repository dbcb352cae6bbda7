"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalink.operators.joins import insert_ignore


def write_lines(df: DataFrame, path: str, line: Column | None = None, files: int | None = None) -> None:
    """Text lines, optionally spread over a given number of files."""
    lines = df if line is None else df.select(line.alias("value"))
    (lines if files is None else lines.repartition(files)).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_keyed_text(df: DataFrame, path: str, key: str, text: str) -> None:
    """(key, text) pairs as a two-column table."""
    df.select(F.col(key).alias("key"), F.col(text).alias("text")).write.parquet(path)


def write_cache(df: DataFrame, path: str) -> DataFrame:
    """Materialise a result and read it back, so that its lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_new_rows(new: DataFrame, existing: DataFrame, key: str, url: str, table: str,
                    batch_size: int = 200, **properties: str) -> None:
    """Append the rows whose key the table lacks, ``batch_size`` rows per statement batch."""
    insert_ignore(new, existing, key).write.jdbc(
        url, table, mode="append", properties={**properties, "batchsize": str(batch_size)})
