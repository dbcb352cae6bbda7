"""Token ids of documents in files of planes, in ascending order of the documents' ids.

Documents are sorted over ranges of their ids; a task encodes its range and writes it to files of
bounded size under names of its own. Only files named in the manifest, which Spark commits with the
job, count: what a lost or repeated task has written is never read. Reading goes through the chunk
index, a bounded run of documents at a time.

The tokenizers library encodes distinct pieces of a slice of documents once each. Pieces end at
blanks and at those borders at which the pre-tokeniser always cuts; words of ASCII letters, which its
normaliser leaves as they are, go straight to the library's model.
"""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from catalink.llm.planes import PlaneReader, PlaneWriter
from catalink.llm.pretokens import shared
from catalink.llm.textbytes import LOWER, byte_slices, id_and_bytes, joined
from catalink.operators.ordered import running_sums
from catalink.session import landed, scratch_path

#: Bytes of text in a range of documents, ids in a file and in a run of documents read together.
PART_BYTES, FILE_IDS, RUN_IDS = 64 << 20, 1 << 25, 1 << 20
#: Bytes of text encoded at a time; a task holds some twenty times as much beside its batch.
SLICE_BYTES = 1 << 20
#: Sections of a file and the widths of their numbers: ids, document ids, whether those are null,
#: ids of each document.
IDS, KEYS, NULLS, LENGTHS = range(4)
WIDTHS = (4, 8, 1, 8)
#: Longest piece whose ids are remembered, pieces remembered, pieces given to the library together.
LONG, REMEMBERED, TOGETHER = 64, 400_000, 1024

# The steps of a tokenizer file for which the cuts below hold.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Classes of bytes: blank, letter, digit, sign, apostrophe, end of a Latin letter of two bytes
# (U+00C0 to U+00FF but for the signs of multiplication and division), part of another character.
_BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _LATIN, _OTHER = range(7)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[128:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE

# Whether a piece ends between two classes. Letters and digits end before any other ASCII
# character, and signs before them; an apostrophe stays with what follows, since the two may be a
# contraction, and what stands before a longer character with it, since the library may compose them.
_CUT = np.zeros((7, 7), bool)
_CUT[_BLANK, 1:] = _CUT[1:, _BLANK] = True
_CUT[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = _CUT[_LATIN, [_DIGIT, _SIGN, _QUOTE]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _SIGN, _QUOTE]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True
_CUT[_QUOTE, _DIGIT] = True


def _classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
    kind[latin] = _LATIN
    return kind


class PieceEncoder:
    """Ids of whole texts by the library, which sees every distinct piece once."""

    def __init__(self, model: str):
        steps = json.loads(model)
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if normal != _NORMAL or split.get("pattern", {}).get("Regex") != _PATTERN:
            raise ValueError("the cuts between pieces do not fit this tokenizer file")
        self.model, self.library = model, Tokenizer.from_str(model)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}

    def __reduce__(self):
        return PieceEncoder, (self.model,)

    def _encoded(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces and their ids as bytes of unsigned 32-bit numbers."""
        model, plain, rest = self.library.model, [], []
        for p in pieces:
            (plain if p.isalpha() and p.isascii() else rest).append(p)
        for p in plain:
            yield p, array("I", [t.id for t in model.tokenize(p.decode())]).tobytes()
        for i in range(0, len(rest), TOGETHER):
            some = rest[i:i + TOGETHER]
            found = self.library.encode_batch_fast(
                [p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            yield from ((p, array("I", e.ids).tobytes()) for p, e in zip(some, found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their number in each text."""
        data, bounds = joined(texts)
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        parts, lengths, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(data):
            end = self._end(data, at)
            kind = _classes(data[at:end])
            new = first[at:end].copy()
            new[0] = True
            new[1:] |= _CUT[kind[:-1], kind[1:]]
            held = kind != _BLANK  # blanks have no ids
            ids, counts = self._pieces(LOWER[data[at:end][held]], np.flatnonzero(new[held]))
            owner = np.searchsorted(bounds, np.flatnonzero(new & held) + at, side="right") - 1
            lengths += np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
            parts.append(ids)
            at = end
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), lengths

    @staticmethod
    def _end(data: np.ndarray, at: int) -> int:
        """End of a stretch that begins at `at`: the last blank in reach, or all."""
        size = SLICE_BYTES
        while at + size < len(data):
            blanks = np.flatnonzero(_CLASS[data[at:at + size]] == _BLANK)
            if len(blanks) and blanks[-1]:
                return at + int(blanks[-1])
            size *= 2
        return len(data)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at `starts`, in order, and the number of each piece's."""
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        _, ends, held = coded.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist()
        held = b"" if held is None else held.to_pybytes()
        distinct = [held[a:b] for a, b in pairwise(ends)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = list(map(self.known.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        own = dict(self._encoded([distinct[i] for i in new]))
        for i in new:
            ids[i] = own[distinct[i]]
        self.known.update((p, x) for p, x in own.items() if len(p) <= LONG)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        counts = sizes[which]
        at = np.cumsum(counts) - counts
        return flat[np.repeat(begins[which] - at, counts) + np.arange(counts.sum())], counts


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more after each document, and the new numbers of ids."""
    lengths = lengths + 1
    out = np.full(int(lengths.sum()), end, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(lengths) - 1] = False
    out[own] = ids
    return out, lengths


MANIFEST = "part int, number int, path string, n_docs long, n_ids long, bytes long"


def write_ids(docs: DataFrame, model_path: str, end: int, folder: str | None = None,
              id_col: str = "doc_id", text_col: str = "text", bits: bool = False,
              part_bytes: int = PART_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents; one row per file in order: MANIFEST and start.

    Ids of each whole text (null: empty), special tokens' strings as plain text, and `end` after
    each. Documents stand in ascending order of their integer ids, null ids last; rows that repeat an
    id follow each other, ordered by text. `start` is the number of ids in all files before. `bits`
    writes bit planes instead of byte planes. `folder` must be on a file system that pyarrow opens
    from all executors; without it a fresh one in the shared folder is taken. A very long text is
    encoded in stretches. Other columns are ignored, whatever their names; an empty table writes no
    file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files") if folder is None else folder
    rows = id_and_bytes(docs, id_col, text_col)
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("ids of documents must be whole numbers")
    with open(model_path, encoding="utf-8") as model:
        library = shared(spark, PieceEncoder(model.read()))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    order = [F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    ordered = rows.withColumns({
        "doc_id": F.col("doc_id").cast("long"), "tie": F.xxhash64("text"),
        "row": F.monotonically_increasing_id()}).repartitionByRange(
            parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads keep memory
        part, number, out = TaskContext.get().partitionId(), 0, None
        encoder = library.kept  # one for all tasks of a worker, since a new one each leaves memory behind
        for piece in byte_slices(batches, SLICE_BYTES):
            if out is None:
                out = TokenFile(folder, part, number, bits)
            ids, lengths = with_end(*encoder.encode(piece.column("text")), end)
            out.append(piece.column("doc_id"), ids, lengths)
            if out.n_ids >= file_ids:
                yield out.close()
                out, number = None, number + 1
        if out is not None:
            yield out.close()

    files = landed(ordered.mapInArrow(write, MANIFEST), "manifest")
    return landed(running_sums(files, [F.asc("part"), F.asc("number")], {"upto": "n_ids"})
                  .withColumn("start", F.col("upto") - F.col("n_ids")).drop("upto"), "files")


class TokenFile:
    """A file being written and its row of the manifest."""

    def __init__(self, folder: str, part: int, number: int, bits: bool):
        self.part, self.number, self.n_docs, self.n_ids = part, number, 0, 0
        self.path = f"{folder}/{part:08d}-{number:06d}-{uuid.uuid4().hex}.ids"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.planes = PlaneWriter(self.stream, WIDTHS, bits)

    def append(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.planes.append(IDS, ids)
        self.planes.append(KEYS, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        self.planes.append(NULLS, keys.is_null().to_numpy(zero_copy_only=False))
        self.planes.append(LENGTHS, lengths)
        self.n_docs += len(keys)
        self.n_ids += len(ids)

    def close(self) -> pa.RecordBatch:
        size = self.planes.close()
        self.stream.close()
        row = (self.part, self.number, self.path, self.n_docs, self.n_ids, size)
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)],
                               [field.split()[0] for field in MANIFEST.split(", ")])


def opened(path: str):
    """A file of planes for reading: the stream, to be closed, and its reader."""
    system, own = fs.FileSystem.from_uri(path)
    stream = system.open_input_file(own)
    return stream, PlaneReader(stream, stream.size())


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents from and up to which about RUN_IDS ids are read together."""
    total, at = np.cumsum(lengths), 0
    while at < len(lengths):
        done = int(total[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + RUN_IDS, side="right")))
        yield at, upto
        at = upto


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files of a manifest: doc_id, start, n_tokens, ids.

    `ids` are little-endian unsigned 32-bit numbers; `start` counts those of all documents before.
    A damaged or shortened file is an error. An empty manifest gives an empty result.
    """
    rows = files.select("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            stream, planes = opened(row["path"])
            with stream:
                at = 0
                for keys, nulls, lengths in zip(*map(planes.blocks, (KEYS, NULLS, LENGTHS))):
                    lengths = lengths.astype(np.int64)
                    for a, b in _runs(lengths):
                        ends = np.cumsum(lengths[a:b])
                        ids = planes.read(IDS, at, at + int(ends[-1]))
                        if len(ids) != ends[-1]:
                            raise ValueError(f"{row['path']} lacks ids")
                        bounds = np.concatenate([[0], ends])
                        yield pa.record_batch([
                            pa.array(keys[a:b].view(np.int64), mask=nulls[a:b].astype(bool)),
                            pa.array(row["start"] + at + bounds[:-1]), pa.array(lengths[a:b]),
                            pa.Array.from_buffers(pa.binary(), b - a, [
                                None, pa.py_buffer((4 * bounds).astype(np.int32)),
                                pa.py_buffer(np.ascontiguousarray(ids))])],
                            ["doc_id", "start", "n_tokens", "ids"])
                        at += int(ends[-1])

    return rows.repartition(max(1, files.count())).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def read_range(files: DataFrame, start: int, stop: int) -> np.ndarray:
    """The ids from `start` up to `stop` of all documents in a row, as a loader reads a batch."""
    parts = []
    for row in files.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)) \
            .orderBy("start").collect():
        stream, planes = opened(row["path"])
        with stream:
            parts.append(planes.read(IDS, max(0, start - row["start"]),
                                     min(row["n_ids"], stop - row["start"])))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def digests(documents: DataFrame) -> DataFrame:
    """Checksums of the ids of documents."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
