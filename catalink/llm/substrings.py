"""Repeated 200-byte strings: blockwise suffix sorting with a difference-cover sample.

Which windows of WINDOW bytes start more than once is read from suffixes sorted by their first
bytes, one range of suffixes at a time and never all of them at once. A difference cover keeps
the sorted suffixes few. Positions whose offset modulo PERIOD lies in COVER form the sample, and any two positions reach
sampled ones by one common step below PERIOD. So two equal windows hold two equal strings of SHORT
bytes at sampled positions, and

1. sample suffixes are ranked by their first SHORT bytes: a window without a tied sample cannot
   repeat;
2. tied sample suffixes are ranked by their first LONG bytes: a tie that long settles all windows
   from the sampled position up to the next PERIOD at once, as in blockwise construction, where
   ranks of the sample decide long ties;
3. the windows that remain open, near the ends of repeats, are sorted one by one, together with
   those settled ones that share a tied sample with an open window and so may equal it.

Order inside a range is that of a 64-bit hash of the compared bytes: ties are what counts here, and
hashes spread hot prefixes evenly. A block asks about each distinct string once, so a string in a
third of all documents is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm import blocks as packing
from catalink.llm.hashing import stretch_hashes
from catalink.session import landed

WINDOW = 200
# A perfect difference set; every residue is a difference of two members.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SHORT, LONG = WINDOW - PERIOD + 1, WINDOW + PERIOD - 1

STAGES = ("short", "long", "open", "window")
_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[list(COVER)] = True
_ASK = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("width", pa.int64()),
                  ("keys", pa.binary()), ("marks", pa.binary())])
_ASK_SQL = "block long, part long, width long, keys binary, marks binary"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()),
                     ("ties", pa.binary())])
_ANSWER_SQL = "block long, part long, n long, ties binary"


class Suffixes:
    """The suffixes of a block's documents and what is known of their ties."""

    def __init__(self, row: dict, bits: int):
        self.row, self.bits = row, bits
        self.data = np.frombuffer(packing.body(row), np.uint8)
        sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        left = np.repeat(self.ends, sizes) - np.arange(len(self.data))
        offset = np.arange(len(self.data)) - np.repeat(self.starts, sizes)
        self.sample = np.flatnonzero(_SAMPLED[offset % PERIOD] & (left >= SHORT))
        self.roomy = left[self.sample] >= LONG
        self.window = left >= WINDOW

    def short_keys(self) -> np.ndarray:
        """Leading bits only: a chance tie costs a further look, never a wrong result."""
        keys = stretch_hashes(self.data, self.sample, SHORT)
        return (keys >> np.uint64(32 - self.bits)) << np.uint64(32 - self.bits)

    def long_keys(self, tied: np.ndarray) -> np.ndarray:
        return stretch_hashes(self.data, self.sample[tied & self.roomy], LONG)

    def open_windows(self, tied: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Marks windows that hold a tied sample but are not settled by a long tie."""
        return self.held_by(tied) & ~self.settle(settled)

    def held_by(self, samples: np.ndarray) -> np.ndarray:
        """Marks windows that hold one of these samples with all its SHORT bytes."""
        return self.spread(self.sample[samples] - (PERIOD - 1), PERIOD) & self.window

    def holding(self, windows: np.ndarray) -> np.ndarray:
        """Marks samples that one of these windows holds."""
        before = np.concatenate([[0], np.cumsum(windows)])
        return before[self.sample + 1] > before[np.maximum(self.sample - (PERIOD - 1), 0)]

    def settle(self, settled: np.ndarray) -> np.ndarray:
        return self.spread(self.sample[settled], PERIOD) & self.window

    def spread(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Marks so many positions from each start; starts may lie before the block."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(starts, 0), 1)
        np.add.at(edge, np.minimum(starts + length, n), -1)
        return np.cumsum(edge[:-1]) > 0


def ask(block: int, keys: np.ndarray, width: int, bits: int,
        marks: np.ndarray | None = None) -> Iterator[dict]:
    """One row for each range of a block's distinct keys; `width` bytes of a key are sent."""
    kinds, inverse = np.unique(keys, return_inverse=True)
    if marks is not None:
        marks = np.bincount(inverse[marks], minlength=len(kinds)) > 0
    for part, own in packing.by_range(kinds, bits):
        found = kinds[own]
        sent = (found if width == 8 else
                (found << np.uint64(bits) >> np.uint64(32)).astype(np.uint32))
        yield {"block": block, "part": part, "width": width, "keys": sent.tobytes(),
               "marks": None if marks is None else np.packbits(marks[own]).tobytes()}


def bits_of(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def answer(table: pa.Table) -> pa.Table:
    """Sort one range of suffixes; tell each block which of its strings other blocks hold too.

    Where strings come with marks, tell which of them any block has marked.
    """
    order = np.argsort(table.column("block").to_numpy(), kind="stable").tolist()
    width = table.column("width")[0].as_py()
    asks = [np.frombuffer(table.column("keys")[i].as_py(), np.uint64 if width == 8 else np.uint32)
            for i in order]
    marks = [table.column("marks")[i].as_py() for i in order]
    if marks[0] is None:
        ranks = np.sort(np.concatenate(asks))
        tied = ranks[1:][ranks[1:] == ranks[:-1]]
    else:
        tied = np.unique(np.concatenate([x[bits_of(m, len(x))] for x, m in zip(asks, marks)]))
    out = []
    for i, x in zip(order, asks):
        at = np.minimum(np.searchsorted(tied, x), max(len(tied) - 1, 0))
        ties = tied[at] == x if len(tied) else np.zeros(len(x), bool)
        out.append({"block": table.column("block")[i].as_py(),
                    "part": table.column("part")[i].as_py(), "n": len(x),
                    "ties": np.packbits(ties).tobytes()})
    return pa.Table.from_pylist(out, _ANSWER)


def resolve(keys: np.ndarray, answers: list[dict], inside: bool = True) -> np.ndarray:
    """Which keys are tied, by the answers of all ranges or, if asked, inside the block itself."""
    kinds, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    if not len(kinds):
        return np.zeros(0, bool)
    ties = np.concatenate([bits_of(a["ties"], a["n"])
                           for a in sorted(answers, key=lambda a: a["part"])])
    return (ties | (counts > 1) if inside else ties)[inverse]


def walk(s: Suffixes, answers: dict[str, list[dict]]):
    """What a block asks next (keys, width, marks); with all answers, its repeated windows."""
    short = s.short_keys()
    tied = resolve(short, answers["short"])
    long = s.long_keys(tied)
    if "long" not in answers:
        return long, 8, None
    settled = np.zeros(len(tied), bool)
    settled[tied & s.roomy] = resolve(long, answers["long"])
    windows = s.open_windows(tied, settled)
    if "open" not in answers:
        return short[tied], 4, s.holding(windows)[tied]
    near = np.zeros(len(tied), bool)
    near[tied] = resolve(short[tied], answers["open"], inside=False)
    repeated = s.settle(settled)
    asked = np.flatnonzero(windows | (repeated & s.held_by(near)))
    keys = stretch_hashes(s.data, asked, WINDOW)
    if "window" not in answers:
        return keys, 8, None
    repeated[asked] |= resolve(keys, answers["window"])
    return repeated


def spans_of(repeated: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[tuple]]:
    """For each document, maximal runs of bytes covered by repeated windows."""
    n = len(repeated)
    edge = np.zeros(n + 1, np.int32)
    first = np.flatnonzero(repeated)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + WINDOW, -1)
    covered = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
    # runs end where a document does, also if the next one begins covered
    step = np.diff(np.concatenate([[0], covered, [0]]))
    border = starts[(starts > 0) & (starts < n)]
    both = border[(covered[border] > 0) & (covered[border - 1] > 0)]
    begins = np.sort(np.concatenate([np.flatnonzero(step > 0), both]))
    stops = np.sort(np.concatenate([np.flatnonzero(step < 0), both]))
    out: list[list[tuple]] = [[] for _ in starts]
    owner = np.searchsorted(ends, begins, side="right")
    for doc, a, b in zip(owner.tolist(), begins.tolist(), stops.tolist()):
        out[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans, kept.

    spans: maximal byte ranges [start, end) covered by a string of 200 bytes that also starts
    anywhere else, in the same document or another; kept: the other bytes. All copies go, also the
    first; matches do not cross documents. Null counts as the empty text; texts under 200 bytes are
    kept whole; rows that repeat remove each other. Other columns of `docs` are ignored; an
    empty table gives an empty result.
    """
    held = packing.bucketed(docs, id_col, text_col)
    bits = packing.range_bits(held)
    kind = held.schema["ids"].dataType.elementType.simpleString()
    parts = ("block", "ids", "sizes", "n_bytes", "body")

    def first(row: dict) -> Iterator[dict]:
        yield from ask(row["block"], Suffixes(row, bits).short_keys(), 4, bits)

    def answers_of(table: pa.Table, stages: tuple[str, ...]) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {s: [] for s in stages}
        for a in table.to_pylist():
            out[a["stage"]].append(a)
        return out

    def further(stages: tuple[str, ...]):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            answers, out = answers_of(right, stages), []
            for row in packing.rows_of(left):
                keys, width, marks = walk(Suffixes(row, bits), answers)
                out += ask(row["block"], keys, width, bits, marks)
            return pa.Table.from_pylist(out, _ASK)

        return run

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = answers_of(right, STAGES), []
        schema = pa.schema([
            ("doc_id", left.schema.field("ids").type.value_type), ("n_bytes", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.binary())])
        for row in packing.rows_of(left):
            suffixes = Suffixes(row, bits)
            spans = spans_of(walk(suffixes, answers), suffixes.starts, suffixes.ends)
            data = suffixes.data.tobytes()
            for doc, a, b, cut in zip(row["ids"], suffixes.starts.tolist(),
                                      suffixes.ends.tolist(), spans):
                edges = [0, *[x for s in cut for x in s], b - a]
                out.append({"doc_id": doc, "n_bytes": b - a,
                            "spans": [{"start": x, "end": y} for x, y in cut],
                            "kept": b"".join(data[a + x:a + y]
                                             for x, y in zip(edges[::2], edges[1::2]))})
        return pa.Table.from_pylist(out, schema)

    def together(answered: dict[str, DataFrame]):
        told = reduce(DataFrame.unionByName,
                      [a.withColumn("stage", F.lit(k)) for k, a in answered.items()])
        return held.select(*parts).groupBy("block").cogroup(told.groupBy("block"))

    asks = held.select(*parts).mapInArrow(packing.map_rows(first, _ASK), _ASK_SQL)
    answered: dict[str, DataFrame] = {}
    for stage in STAGES:
        if answered:
            asks = together(answered).applyInArrow(further(tuple(answered)), _ASK_SQL)
        answered[stage] = landed(asks.groupBy("part").applyInArrow(answer, _ANSWER_SQL), stage)
    return together(answered).applyInArrow(
        finish, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, "
                "kept binary")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digest of what each document keeps."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
