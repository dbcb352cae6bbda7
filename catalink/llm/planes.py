"""Files of whole numbers in bit planes.

A section is a sequence of unsigned numbers of one width, cut into blocks of BLOCK. The numbers of a
block are transposed, so that equal bytes, or equal bits, of all of them stand together, and each of
these planes is compressed by itself. The chunk index at the end of the file tells of every block
where it lies and which numbers it holds, so any range is read without the rest.

    MAGIC | chunks of all sections | index | footer
    chunk:  length of each plane (u4), planes (zstandard)
    index:  one INDEX row a chunk
    footer: offset of the index (u8), chunks (u8), crc32 of the index (u4), MAGIC
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"IDPLANE1"
FOOTER = "<QQI8s"
#: Numbers in a block.
BLOCK = 1 << 16
#: Width of a number in bytes, kind of planes, first number, numbers, offset and bytes of the chunk.
INDEX = np.dtype([("section", "<u1"), ("width", "<u1"), ("bits", "<u1"), ("first", "<u8"),
                  ("count", "<u4"), ("offset", "<u8"), ("size", "<u8")])


def transposed(block: np.ndarray, bits: bool) -> np.ndarray:
    """Planes of a block, lowest first: one row a byte, or a bit, of the numbers."""
    planes = np.ascontiguousarray(block.view(np.uint8).reshape(len(block), -1).T)
    if not bits:
        return planes
    each = (planes[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
    return np.packbits(each.reshape(-1, planes.shape[1]), axis=1)


def put_back(planes: np.ndarray, count: int, bits: bool, width: int) -> np.ndarray:
    """Numbers of a block from its planes."""
    if bits:
        each = np.unpackbits(planes, axis=1, count=count).reshape(width, 8, count)
        planes = np.bitwise_or.reduce(
            each << np.arange(8, dtype=np.uint8)[None, :, None], axis=1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


class PlaneWriter:
    """Writes sections to a binary stream; holds less than one block of each."""

    def __init__(self, out, widths: tuple[int, ...], bits: bool = False, level: int = 3):
        self.out, self.widths, self.bits = out, widths, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held = [np.zeros(0, f"<u{w}") for w in widths]
        self.counts, self.index, self.at = [0] * len(widths), [], len(MAGIC)
        out.write(MAGIC)

    def append(self, section: int, numbers: np.ndarray) -> None:
        held = np.concatenate([self.held[section], numbers.astype(self.held[section].dtype)])
        for at in range(0, len(held) - BLOCK + 1, BLOCK):
            self._chunk(section, held[at:at + BLOCK])
        self.held[section] = held[len(held) // BLOCK * BLOCK:]

    def _chunk(self, section: int, block: np.ndarray) -> None:
        planes = [self.zip.compress(p.tobytes()) for p in transposed(block, self.bits)]
        body = b"".join([np.array([len(p) for p in planes], "<u4").tobytes(), *planes])
        self.index.append((section, self.widths[section], self.bits, self.counts[section],
                           len(block), self.at, len(body)))
        self.out.write(body)
        self.at += len(body)
        self.counts[section] += len(block)

    def close(self) -> int:
        """Write what is held, the index and the footer; the size of the file."""
        for section, block in enumerate(self.held):
            if len(block):
                self._chunk(section, block)
        index = np.array(self.index, INDEX).tobytes()
        self.out.write(index)
        self.out.write(struct.pack(FOOTER, self.at, len(self.index), zlib.crc32(index), MAGIC))
        return self.at + len(index) + struct.calcsize(FOOTER)


class PlaneReader:
    """Reads ranges of the sections of a seekable binary stream of known size."""

    def __init__(self, source, size: int):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(max(0, size - struct.calcsize(FOOTER)))
        tail = source.read(struct.calcsize(FOOTER))
        if len(tail) < struct.calcsize(FOOTER) or tail[-8:] != MAGIC:
            raise ValueError("not a file of planes, or cut short")
        at, chunks, crc, _ = struct.unpack(FOOTER, tail)
        source.seek(at)
        rows = source.read(chunks * INDEX.itemsize)
        if len(rows) != chunks * INDEX.itemsize or zlib.crc32(rows) != crc:
            raise ValueError("the chunk index is damaged")
        self.index = np.frombuffer(rows, INDEX)

    def count(self, section: int) -> int:
        return int(self.index["count"][self.index["section"] == section].sum())

    def blocks(self, section: int, start: int = 0,
               stop: int | None = None) -> Iterator[np.ndarray]:
        """Numbers from `start` up to `stop`, a block at a time; other blocks are not read."""
        rows = self.index[self.index["section"] == section]
        first = rows["first"].astype(np.int64)
        ends = first + rows["count"]
        stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
        for i in np.flatnonzero((ends > start) & (first < stop)):
            block = self._block(rows[i])
            yield block[max(0, start - int(first[i])):stop - int(first[i])]

    def _block(self, row: np.void) -> np.ndarray:
        self.source.seek(int(row["offset"]))
        body = self.source.read(int(row["size"]))
        width, count, bits = int(row["width"]), int(row["count"]), bool(row["bits"])
        n = width * 8 if bits else width
        ends = 4 * n + np.cumsum(np.frombuffer(body, "<u4", n).astype(np.int64))
        starts = [4 * n, *ends[:-1].tolist()]
        planes = [np.frombuffer(self.unzip.decompress(body[a:b]), np.uint8)
                  for a, b in zip(starts, ends.tolist())]
        return put_back(np.stack(planes), count, bits, width)

    def read(self, section: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        parts = list(self.blocks(section, start, stop))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
