"""Rank files and pre-tokens, shared by the byte-level tokenisers."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

_BLANK_PAIR = re.compile(r"\s\s")
#: Bytes of text worked on at a time in a task, and words remembered by it.
SLICE_BYTES, REMEMBERED = 4 << 20, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def lengths_by_end(tokens) -> dict[bytes, tuple[int, ...]]:
    """For the last two bytes of a token, the lengths such tokens have, longest first."""
    found = defaultdict(set)
    for token in tokens:
        if len(token) > 1:
            found[token[-2:]].add(len(token))
    return {end: tuple(sorted(n, reverse=True)) for end, n in found.items()}


def pieces(text: str) -> list[str]:
    """Cut a text where single blanks stand; the pre-tokens of the pieces are those of the text.

    A blank between two other characters always begins a new pre-token, and what follows does not
    depend on what came before. Where two white-space characters meet that does not hold, so such
    a text stays whole.
    """
    if not text:
        return []
    if _BLANK_PAIR.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def splitter(pattern: str):
    return regex.compile(pattern).findall


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of a few documents at a time; a long one comes alone."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= SLICE_BYTES or i + 1 == len(texts):
                yield ids.slice(start, i + 1 - start), [x or "" for x in texts[start:i + 1]]
                start, held = i + 1, 0


class Shared:
    """A broadcast value whose classes travel with it, so executors need no copy of the package."""

    def __init__(self, packed: Broadcast):
        self._packed = packed

    @cached_property
    def value(self):
        return cloudpickle.loads(self._packed.value)

    @property
    def kept(self):
        """The value, one for all tasks of a worker; what a task remembers in it serves the next."""
        if not hasattr(self._packed, "unpacked"):  # a worker holds one Broadcast for all its tasks
            self._packed.unpacked = self.value
        return self._packed.unpacked


def shared(spark: SparkSession, value) -> Shared:
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
