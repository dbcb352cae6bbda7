"""Documents packed into blocks of a few MB, so that what is exchanged about them is packed too.

An operator that must ask the whole corpus about many small things (words, windows) sends one row
for each block and range of hashes instead of one for each thing, and gets its answers by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.session import landed, scratch_path

#: Text bytes in a block (more only where a single document is longer).
BLOCK_BYTES = 4 << 20
#: Text bytes for which the exchange gets one range of hashes.
RANGE_BYTES = 16 << 20


def packed(docs: DataFrame, id_col: str, text_col: str, flag: Column) -> DataFrame:
    """Blocks of neighbouring documents, written: block, ids, flags, sizes, n_bytes, body."""
    return landed(pack_rows(docs, id_col, text_col, flag), "blocks")


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same, written in buckets by block: answers join without shuffling the texts again."""
    spark = docs.sparkSession
    path = scratch_path(spark, "blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(8, docs.select(F.col(f"`{text_col}`")).rdd.getNumPartitions())
    (pack_rows(docs, id_col, text_col, F.lit(False)).write.option("path", path)
     .bucketBy(buckets, "block").saveAsTable(name))
    return spark.table(name)


def pack_rows(docs: DataFrame, id_col: str, text_col: str, flag: Column) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(flag, F.lit(False)).alias("flag"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            start, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held < BLOCK_BYTES and i + 1 < len(texts):
                    continue
                n, ids, flags = i + 1 - start, batch.column(0), batch.column(2)
                one = pa.array([0, n], pa.int32())
                body = pa.compress(b"".join(texts[start:i + 1]), codec="zstd", asbytes=True)
                yield pa.record_batch([
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(one, ids.slice(start, n)),
                    pa.ListArray.from_arrays(one, flags.slice(start, n)),
                    pa.array([[len(t) for t in texts[start:i + 1]]], pa.list_(pa.int64())),
                    pa.array([held], pa.int64()), pa.array([body], pa.binary())],
                    ["block", "ids", "flags", "sizes", "n_bytes", "body"])
                number, start, held = number + 1, i + 1, 0

    return rows.mapInArrow(
        pack, f"block long, ids array<{kind}>, flags array<boolean>, sizes array<long>, "
              "n_bytes long, body binary")


def body(row: dict) -> bytes:
    """The joined texts of a block row."""
    return pa.decompress(row["body"], row["n_bytes"], codec="zstd", asbytes=True)


def rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one converted at a time."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def map_rows(fn: Callable[[dict], Iterator[dict]], schema: pa.Schema):
    """A function for mapInArrow from one that turns a row into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                for out in fn(row):
                    yield pa.RecordBatch.from_pylist([out], schema)

    return run


def range_bits(blocks: DataFrame) -> int:
    """Leading hash bits that name a range, so that a range's share of the corpus is bounded."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, int(total // RANGE_BYTES).bit_length())


def by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges that occur among sorted 64-bit hashes, each with its part of them."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, first = np.unique(ranges, return_index=True)
    for r, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield r, slice(a, b)
