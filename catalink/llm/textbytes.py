"""Texts of documents as UTF-8 bytes, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at a time in a task; a longer text comes alone.
SLICE_BYTES = 4 << 20

#: A to Z lowered, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def named(column: str) -> Column:
    """A column by its name alone, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any spelling."""
    taken = {c.lower() for f in frames for c in f.columns}
    name, k = stem, 0
    while name.lower() in taken:
        name, k = f"{stem}_{k}", k + 1
    return name


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """doc_id, text (UTF-8 bytes; null: empty) and further columns made of the input's."""
    text = F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(named(id_col).alias("doc_id"), text.alias("text"),
                       *[column.alias(name) for name, column in more.items()])


def byte_slices(batches: Iterator[pa.RecordBatch],
                size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches with about `size` bytes of text each."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and where each text begins and the last one ends."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    held = texts.buffers()[2]
    if held is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(held, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0]))
    return data, (bounds - bounds[0]).astype(np.int64)


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the given stretches, which follow each other without overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
