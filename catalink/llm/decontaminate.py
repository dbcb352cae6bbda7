"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark windows.

A shard is a few MB of neighbouring documents in one task; texts are not shuffled. Its words are
numbered by the benchmark's vocabulary, and words no benchmark item holds end a stretch, because no
window can run across them. All windows are searched at once, word by word from the right;
occurrences are located by sampled suffix positions and merged into removal spans.

The benchmark reaches the tasks in blocks of at most BLOCK_BYTES, each a pass of its own over the
rows, so no broadcast grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.fm_index import FMIndex
from catalink.llm.pretokens import shared, slices

#: Words in a window, and bytes of benchmark text searched for in one pass.
WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Digits, letters and all bytes of other scripts are word bytes; capitals A-Z are lowered.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else
                    c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
SCHEMA = ("doc_id {}, text string, n_words long, "
          "spans array<struct<start:long,end:long>>, items array<string>")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class Windows:
    """The distinct windows of a block of items, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                       for w in words(text)]
            for i in range(max(len(numbers) - size + 1, min(len(numbers), 1))):
                found.setdefault(tuple(numbers[i:i + size]), set()).add(name)
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.phrases = np.zeros((len(found), size), np.int64)
        for row, x in zip(self.phrases, found):
            row[:len(x)] = x
        self.items = [sorted(x) for x in found.values()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def search_shard(texts: list[str], windows: Windows):
    """For each text: number of words, spans of words inside an occurrence, items that occur."""
    known = windows.vocabulary.get
    numbered = []
    for text in texts:
        found = words(text)
        numbered.append(np.fromiter(chain(map(known, found, repeat(0)), (0,)),
                                    np.int64, len(found) + 1))
    counts = np.array([len(x) - 1 for x in numbered])
    starts = np.cumsum(np.append(0, counts + 1))
    text = np.concatenate(numbered)
    keep = (text > 0) | np.append(True, text[:-1] > 0)  # the first end of each row of ends
    place = np.flatnonzero(keep)
    index = FMIndex(text[keep], len(windows.vocabulary) + 1)
    low, high = index.search(windows.phrases, windows.lengths)
    which = np.flatnonzero(high > low)
    n = high[which] - low[which]
    rows = np.repeat(low[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
    window = np.repeat(which, n)
    at = place[index.locate(rows)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + windows.lengths[window], -1)
    hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    change = np.diff(hit)
    begins, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    owner = np.searchsorted(starts, begins, side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for doc, a, b in zip(owner.tolist(), begins.tolist(), ends.tolist()):
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    items: list[set[str]] = [set() for _ in texts]
    doc_window = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(windows.items)
                           + window) if len(at) else []
    for x in doc_window:
        doc, w = divmod(int(x), len(windows.items))
        items[doc].update(windows.items[w])
    return counts, spans, items


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items, a bounded block at a time; an item is never cut."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")),
                            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    block, held = [], 0
    for name, text in rows.toLocalIterator():
        block.append((name, text))
        held += len(text) + len(name)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, spans, items.

    spans: merged word ranges [start, end) inside any occurrence of a window; items: names of the
    items with occurring windows, sorted as strings. Null texts have no words; items without words
    occur nowhere; an item without a name is called the empty string; repeated items count once.
    Repeated rows are searched like any other. Other columns of `docs` are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = SCHEMA.format(rows.schema["doc_id"].dataType.simpleString())

    def searched(block: list[tuple[str, str]] | None, earlier: bool, last: bool):
        held = shared(spark, Windows(block or [], window))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for ids, texts in slices([batch]):
                    counts, spans, items = search_shard(texts, held.value)
                    if earlier:
                        old = batch.slice(done, len(texts))
                        for i, (s, x) in enumerate(zip(old.column(3).to_pylist(),
                                                       old.column(4).to_pylist())):
                            spans[i] = merged(spans[i] + [(y["start"], y["end"]) for y in s])
                            items[i].update(x)
                    done += len(texts)
                    yield pa.record_batch([
                        ids, pa.array([None] * len(texts) if last else texts, pa.string()),
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                        ["doc_id", "text", "n_words", "spans", "items"])

        return search

    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    now, earlier = next(blocks, None), False
    while True:
        after = next(blocks, None)
        rows = rows.mapInArrow(searched(now, earlier, after is None), schema)
        if after is None:
            return rows.drop("text")
        now, earlier = after, True


def summary(found: DataFrame) -> DataFrame:
    """Counts and digest of the items for each searched document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text",
                    window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no window, all columns kept; no row is shuffled."""
    spark = docs.sparkSession

    def holds(block: list[tuple[str, str]]) -> Column:
        held = shared(spark, Windows(block, window))

        @F.pandas_udf("boolean")
        def search(texts: pd.Series) -> pd.Series:
            batch = pa.record_batch([pa.nulls(len(texts)), pa.array(texts, pa.string())],
                                    ["id", "text"])
            return pd.Series([bool(s) for _, some in slices([batch])
                              for s in search_shard(some, held.value)[1]], dtype=bool)

        return search(F.col(f"`{text_col}`").cast("string"))

    found = [holds(b) for b in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)]
    return docs.filter(~reduce(or_, found)) if found else docs


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    data = text.encode()
    mark = data.translate(_WORD_BYTES)
    inside = np.frombuffer(mark, np.uint8) != 32
    change = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:begins[start]])
        at = int(ends[end - 1])
    return b"".join([*out, data[at:]]).decode()

