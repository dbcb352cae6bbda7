"""Fill-in-middle documents by piece tables.

A document is a row of descriptors over two immutable buffers, its text and the sentinels. Cutting
splits descriptors, an arrangement permutes them, and digests stream over them, so no text is copied
until it is written out. An output is taken apart the same way: its sentinels split it into six
descriptors, the inverse permutation puts them back in order, and the first three are the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.llm.textbytes import byte_slices, id_and_bytes, named

#: Prefix, suffix and middle sentinel.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Where the descriptors prefix, middle, suffix and the three sentinels go in an output.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: Bytes scanned, hashed or written at a time.
STEP = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class PieceTable:
    """Descriptors (buffer, start, end) over immutable buffers."""

    def __init__(self, buffers: Sequence[bytes], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = tuple(buffers), pieces

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text, b"".join(SENTINELS)), [(0, 0, len(text))])

    def cut(self, place: int) -> None:
        """Split the descriptor that holds this byte of the document; its ends make an empty one."""
        before = 0
        for i, (buffer, start, end) in enumerate(self.pieces):
            if place <= before + end - start:
                at = start + place - before
                self.pieces[i:i + 1] = [(buffer, start, at), (buffer, at, end)]
                return
            before += end - start
        raise ValueError("a cut lies behind the end")

    def add_sentinels(self) -> None:
        at = 0
        for sentinel in SENTINELS:
            self.pieces.append((1, at, at + len(sentinel)))
            at += len(sentinel)

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def first(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[:n])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            view = memoryview(self.buffers[buffer])
            for at in range(start, end, STEP):
                yield view[at:min(end, at + STEP)]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def written(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: Sequence[int]) -> list[int]:
    back = [0] * len(order)
    for place, piece in enumerate(order):
        back[piece] = place
    return back


def _begins(text: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes of one step: which begin a code point, which begin a unit."""
    data = np.frombuffer(text, np.uint8, min(STEP, len(text) - at), at)
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    after = np.empty_like(letter)
    after[0] = at > 0 and _LETTER[text[at - 1]]
    after[1:] = letter[:-1]
    return point, point & ~(letter & after)


class Units:
    """Runs of ASCII letters, and all other code points one by one; counted step by step."""

    def __init__(self, text: bytes):
        self.text = text
        self.points, self.units = [0], [0]
        for at in range(0, len(text), STEP):
            point, unit = _begins(text, at)
            self.points.append(self.points[-1] + int(np.count_nonzero(point)))
            self.units.append(self.units[-1] + int(np.count_nonzero(unit)))

    def __len__(self) -> int:
        return self.units[-1]

    def place(self, k: int) -> tuple[int, int]:
        """Byte and code point at which unit k begins; k may be the number of units."""
        if k >= len(self):
            return len(self.text), self.points[-1]
        step = int(np.searchsorted(self.units, k, side="right")) - 1
        point, unit = _begins(self.text, step * STEP)
        inside = int(np.flatnonzero(unit)[k - self.units[step]])
        return (step * STEP + inside,
                self.points[step] + int(np.count_nonzero(point[:inside])))


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: groups of the digest of the seed and its id."""
    named_id = F.coalesce(named(id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), named_id).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(text: bytes, h: Sequence[int], plain: int,
                spm: int) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Number of units, form, code points of prefix and middle, and the arranged table."""
    units, table = Units(text), PieceTable.of(text)
    n = len(units)
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, table
    (a, a_points), (b, b_points) = map(units.place, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    table.cut(b)
    table.cut(a)
    table.add_sentinels()
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, a_points, b_points - a_points, table.arranged(ARRANGEMENTS[form])


def taken_apart(output: bytes, form: str) -> PieceTable:
    """The text's own pieces, found in an output by its sentinels.

    No sentinel stands in the text of a rearranged document, and none can arise across a border:
    each begins with `<`, which stands nowhere else in a sentinel. So the first one found after the
    one before is the one that was put there.
    """
    if form == "plain":
        return PieceTable.of(output)
    order = ARRANGEMENTS[form]
    pieces, at = [], 0
    for sentinel, following in zip(order[::2], [*order[2::2], None]):
        mark = SENTINELS[sentinel - 3]
        at += len(mark)
        end = len(output) if following is None else output.index(SENTINELS[following - 3], at)
        pieces += [(0, at - len(mark), at), (0, at, end)]
        at = end
    return PieceTable((output,), pieces).arranged(inverse(order)).first(3)


MADE = ("doc_id {}, n long, form string, prefix_chars long, middle_chars long, output binary, "
        "output_sha256 string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256.

    `output` is the rearranged text; of 100 documents `plain` stay as they are, and `spm` of 100
    others put the suffix first. Texts that are null or empty or hold a sentinel stay plain, with
    null counts. Draws depend on the seed and the id alone, so rows that repeat an id are cut at the
    same draws; a null id counts as an empty one. Very long texts are scanned and hashed step by
    step. Other columns of `docs` are ignored, whatever their names; an empty table gives an empty
    result.
    """
    h = draws(id_col, seed)
    rows = id_and_bytes(docs, id_col, text_col, **{f"h{i}": c for i, c in enumerate(h)})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            numbers = zip(*(part.column(f"h{i}").to_pylist() for i in range(4)))
            made = [transformed(t, x, plain, spm)
                    for t, x in zip(part.column("text").to_pylist(), numbers)]
            n, form, prefix, middle, tables = zip(*made)
            yield pa.record_batch([
                part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array([t.written() for t in tables], pa.binary()),
                pa.array([t.sha256() for t in tables], pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    made = rows.mapInArrow(make, MADE.format(rows.schema["doc_id"].dataType.simpleString()))
    return made.withColumn("output", F.col("output").cast("string"))


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """All columns of `outputs` and, rebuilt from its two named ones, restored and restored_sha256.

    A null output counts as an empty one, a null form as plain; columns that have the new names
    already are replaced. Every row is put back for itself, so repeated rows are no special case.
    """
    kept = [c for c in outputs.columns if c not in ("restored", "restored_sha256")]
    rows = outputs.select(
        F.struct(*map(named, kept)).alias("row"),
        F.coalesce(named(output).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(named(form), F.lit("plain")).alias("form"))
    schema = T.StructType([rows.schema["row"], T.StructField("restored", T.BinaryType()),
                           T.StructField("restored_sha256", T.StringType())])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            tables = [taken_apart(t, f) for t, f in zip(
                part.column("text").to_pylist(), part.column("form").to_pylist())]
            yield pa.record_batch([
                part.column("row"), pa.array([t.written() for t in tables], pa.binary()),
                pa.array([t.sha256() for t in tables], pa.string())],
                ["row", "restored", "restored_sha256"])

    return rows.mapInArrow(put_back, schema).select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("restored").cast("string").alias("restored"), "restored_sha256")
