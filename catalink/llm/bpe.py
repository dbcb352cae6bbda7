"""Byte-level BPE by dynamic programming over prefixes.

The last token of the encoding of a byte prefix is unique: it is the one token that ends there and
that keeps its border with the last token of what stands before it. A table from prefix to last
token therefore holds the encodings of all prefixes at once. Words that share a prefix share its
entries, appending bytes continues from them, and an edit re-encodes only from where it begins.
A pre-token over LONG bytes keeps its last tokens in an array by position instead, since its
prefixes as keys would take the square of its length; the next long one continues from it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.pretokens import lengths_by_end, read_ranks, shared, splitter
from catalink.llm.textbytes import byte_slices, id_and_bytes, joined

#: Longest pre-token, in bytes, whose prefixes or ids are remembered by their text; longest one
#: whose array is kept for the next.
LONG, LONG_KEPT = 64, 1 << 20
#: Pre-tokens and pieces remembered by a worker, and half the prefixes and borders.
REMEMBERED = 200_000
#: Short pre-tokens encoded together.
TOGETHER = 16_384


# Fixed value: the pattern for which the cuts below hold; texts stay whole under another one.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Classes of bytes: part of a character that may be anything, blank, other white space, letter,
# digit, sign, apostrophe, part of a character of two bytes that is not white (U+00C0 to U+07FF).
_ANY, _BLANK, _WHITE, _LETTER, _DIGIT, _SIGN, _QUOTE, _TWO = range(8)
_CLASS = np.full(256, _ANY, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[9, 10, 11, 12, 13]] = _WHITE
_CLASS[32], _CLASS[39] = _BLANK, _QUOTE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[0xC3:0xE0] = _TWO

# Whether a pre-token always ends between two classes: before white space, which may only begin one,
# and where letters, digits and signs meet, but not after an apostrophe, which may begin a contraction.
_CUT = np.zeros((8, 8), bool)
_CUT[_LETTER:, [_BLANK, _WHITE]] = True
_CUT[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = _CUT[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 surely begins a pre-token of PATTERN; others may begin one too."""
    kind = _CLASS[data]
    kind[1:][kind[:-1] == _TWO] = _TWO
    out = np.zeros(len(data), bool)
    out[1:] = _CUT[kind[:-1], kind[1:]]
    # white space that stands alone and is no blank; the end of a piece would split a run otherwise
    out[2:] |= (kind[:-2] >= _LETTER) & (kind[1:-1] == _WHITE) & (kind[2:] >= _LETTER)
    return out


def merge_all(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging, lowest rank first, of ranks under `below`; used to prepare the tables."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (below is None or rank < below) and (
                    best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def token_tables(ranks: dict[bytes, int]) -> dict:
    """What encoding needs of a rank file: halves of each token's last merge, tokens in use."""
    halves: dict[int, tuple[int, int]] = {}
    used: dict[bytes, int] = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            used[token] = rank
            continue
        parts = merge_all(token, ranks, rank)
        if len(parts) == 2:  # others are never made by merging, only as a whole pre-token
            halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            used[token] = rank
    return {"ranks": ranks, "used": used, "halves": halves, "ends": lengths_by_end(used),
            **automaton(used), "tokens": {rank: token for token, rank in ranks.items()}}


def automaton(used: dict[bytes, int]) -> dict:
    """Tries of tokens: moves by state and byte, the state of the longest proper suffix of each
    state, and the tokens that end in it with their lengths, longest first."""
    trie: dict[int, int] = {}
    own: dict[int, tuple[int, int]] = {}
    for token, rank in used.items():
        state = 0
        for byte in token:
            state = trie.setdefault(state << 8 | byte, len(trie) + 1)
        own[state] = (rank, len(token))
    fails, endings = [0] * (len(trie) + 1), [()] * (len(trie) + 1)
    below: dict[int, list[int]] = {}
    for move in trie:
        below.setdefault(move >> 8, []).append(move)
    level = [0]
    while level:  # level by level, so that suffixes are known
        following = []
        for parent in level:
            for move in below.get(parent, ()):
                state, at = trie[move], fails[parent]
                while at and (at << 8 | move & 255) not in trie:
                    at = fails[at]
                fails[state] = trie.get(at << 8 | move & 255, 0) if parent else 0
                endings[state] = (*([own[state]] if state in own else ()), *endings[fails[state]])
                following.append(state)
        level = following
    moves = np.array(sorted(trie.items()), np.int64).reshape(-1, 2)
    return {"moves": moves[:, 0].copy(), "reached": moves[:, 1].copy(), "fails": np.array(fails, np.int64),
            "endings": np.array([x for e in endings for x in e], np.int32).reshape(-1, 2).T.copy(),
            "first_ending": np.cumsum([0, *map(len, endings)])}


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of the entries of stretches, one stretch after the other."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


class PrefixEncoder:
    """Encodes pre-tokens; keeps the last token of every prefix met, of long ones the latest only."""

    def __init__(self, tables: dict):
        self.__dict__.update(tables)
        self.last: dict[bytes, int] = {}
        self.long, self.long_last = b"", array("i")
        self.borders: dict[tuple[int, int], bool] = {}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))

    def keeps_border(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives back exactly these two.

        Merges are undone, latest first. At each moment the two tokens that touch the border must
        not merge with a lower rank than the merge undone last.
        """
        known = self.borders.get((left, right))
        if known is not None:
            return known
        a, b, limit, tokens, keeps = left, right, None, self.tokens, True
        while True:
            both = self.ranks.get(tokens[a] + tokens[b])
            # at equal rank the merge further left comes first
            if both is not None and (limit is None or both < limit):
                keeps = False
                break
            parts_a, parts_b = self.halves.get(a), self.halves.get(b)
            if parts_a is None and parts_b is None:
                break
            if parts_b is None or (parts_a is not None and a > b):
                limit, a = a, parts_a[1]
            else:
                limit, b = b + 1, parts_b[0]
        if len(self.borders) > 2 * REMEMBERED:
            self.borders.clear()
        self.borders[(left, right)] = keeps
        return keeps

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG:
            return self.encode_long(piece)
        last, used, ends = self.last, self.used, self.ends
        if len(last) > 2 * REMEMBERED:
            last.clear()
        size = len(piece)
        known = size  # longest prefix whose encoding is stored
        while known and piece[:known] not in last:
            known -= 1
        for i in range(known + 1, size + 1):
            found = used[piece[i - 1:i]] if i == 1 else None
            if found is None:
                for n in ends.get(piece[i - 2:i], ()):
                    if n > i:
                        continue
                    token = used.get(piece[i - n:i])
                    if token is not None and (
                            n == i or self.keeps_border(last[piece[:i - n]], token)):
                        found = token
                        break
                else:
                    found = used[piece[i - 1:i]]
            last[piece[:i]] = found
        out, at = [], size
        while at:
            token = last[piece[:at]]
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encodings of pre-tokens in ascending order."""
        ids, counts = self.encode_together(pieces)
        ends = np.cumsum(counts)
        return (ids[a:b].tolist() for a, b in zip(ends - counts, ends))

    def encode_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in ascending order, all in a row, and the number of each's."""
        whole = np.array([-1 if r is None else r for r in map(self.ranks.get, pieces)], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        parts = []
        short = np.flatnonzero((whole < 0) & (sizes <= LONG))
        for at in range(0, len(short), TOGETHER):
            own = short[at:at + TOGETHER]
            ids, counts[own] = self._by_position([pieces[i] for i in own], sizes[own])
            parts.append((own, ids))
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)):
            ids = np.array(self.encode_long(pieces[i]), np.int32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        known = whole >= 0
        out[starts[known]] = whole[known]
        for own, ids in parts:
            out[places(starts[own], counts[own])] = ids
        return out, counts

    def _by_position(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of a few short ones, position by position: row i of a table holds the last tokens
        of their first i bytes. What a pre-token shares with the one before is taken from there."""
        n, longest = len(pieces), int(sizes.max())
        data = np.zeros((n, longest), np.uint8)
        data[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        differ = data[1:] != data[:-1]
        same = np.zeros(n, np.int64)
        same[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), longest),
                              np.minimum(sizes[1:], sizes[:-1]))
        data = np.ascontiguousarray(data.T)
        last = np.full((longest + 1, n), -1, np.int32)
        state, line = np.zeros(n, np.int64), np.arange(n)
        for i in range(1, longest + 1):
            new = np.flatnonzero((same < i) & (sizes >= i))
            state[new] = self._moved(state[new], data[i - 1, new])
            last[i, new] = self._last_tokens(state[new], last, new, i)
            owner = np.zeros(n, np.int64)
            owner[new] = new
            np.maximum.accumulate(owner, out=owner)
            state, last[i] = state[owner], last[i, owner]
        out, at = [], sizes.copy()
        while len(line):
            token = last[at[line], line]
            out.append((line, token))
            at[line] -= self.sizes[token]
            line = line[at[line] > 0]
        lines, tokens = (np.concatenate(x) for x in zip(*reversed(out)))
        order = np.argsort(lines, kind="stable")
        return tokens[order], np.bincount(lines, minlength=n)

    def _moved(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """States of the automaton of tokens after one more byte each."""
        out, left, state = np.zeros(len(states), np.int64), np.arange(len(states)), states.copy()
        while len(left):
            move = state[left] << 8 | data[left]
            at = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
            found = self.moves[at] == move
            out[left[found]] = self.reached[at[found]]
            left = left[~found & (state[left] > 0)]
            state[left] = self.fails[state[left]]
        return out

    def _last_tokens(self, states: np.ndarray, last: np.ndarray, own: np.ndarray,
                     i: int) -> np.ndarray:
        """Last tokens of prefixes of i bytes, which are in these states of the automaton."""
        out, left = np.zeros(len(states), np.int32), np.arange(len(states))
        at, end = self.first_ending[states], self.first_ending[states + 1] - 1
        while len(left):
            found, size = self.endings[:, at[left]]
            keeps = (size == i) | (at[left] == end[left])  # the last of them is the byte alone
            rest = np.flatnonzero(~keeps)
            if len(rest):
                keeps[rest] = self._keep_borders(last[i - size[rest], own[left[rest]]], found[rest])
            out[left[keeps]] = found[keeps]
            left = left[~keeps]
            at[left] += 1
        return out

    def _keep_borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, which = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        held = list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()))
        known = list(map(self.borders.get, held))
        return np.array([self.keeps_border(*p) if k is None else k
                         for p, k in zip(held, known)], bool)[which]

    def encode_long(self, piece: bytes) -> list[int]:
        """The same by positions: entry i is the last token of the first i bytes."""
        used, ends, size = self.used, self.ends, len(piece)
        known = min(size, len(self.long))
        differ = (np.frombuffer(piece, np.uint8, known)
                  != np.frombuffer(self.long, np.uint8, known)).nonzero()[0]
        last = self.long_last[:(int(differ[0]) if len(differ) else known) + 1] or array("i", [-1])
        for i in range(len(last), size + 1):
            found = None
            for n in ends.get(piece[i - 2:i], ()) if i > 1 else ():
                if n > i:
                    continue
                token = used.get(piece[i - n:i])
                if token is not None and (n == i or self.keeps_border(last[i - n], token)):
                    found = token
                    break
            last.append(used[piece[i - 1:i]] if found is None else found)
        self.long, self.long_last = (piece, last) if size <= LONG_KEPT else (b"", array("i"))
        out, at = [], size
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def append(self, piece: bytes, more: bytes) -> list[int]:
        """Encoding of a stored pre-token with bytes appended: only the new prefixes are worked out."""
        return self.encode(piece + more)


class TextEncoder:
    """Encodes and decodes texts; pieces and pre-tokens are numbered, and ids gathered by numbers."""

    def __init__(self, tables: dict, pattern: str):
        self.tables, self.pattern = tables, pattern
        self.encoder, self.split = PrefixEncoder(tables), splitter(pattern)
        tokens = tables["tokens"]
        self.tokens = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.binary())
        self.forget()

    def __reduce__(self):
        return TextEncoder, (self.tables, self.pattern)

    def forget(self) -> None:
        """Forget what is numbered: pieces with the numbers of their pre-tokens, and these with ids."""
        self.pieces: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}
        self.inside, self.piece_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.ids, self.word_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes) in a row, and where each text's begin and the last one's end."""
        if max(len(self.words), len(self.pieces)) > REMEMBERED:
            self.forget()
        data, bounds = joined(texts)
        first = piece_starts(data) if self.pattern == PATTERN else np.zeros(len(data), bool)
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        long = self._learn([p for p in distinct if p not in self.pieces])
        number = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))
        number = number[coded.indices.to_numpy()]
        bounds = np.searchsorted(starts, bounds)
        counts = np.diff(self.piece_ends)[number]
        bounds = np.concatenate([[0], np.cumsum(counts)])[bounds]
        number = self.inside[places(self.piece_ends[number], counts)]
        counts = np.diff(self.word_ends)[number]
        bounds = np.concatenate([[0], np.cumsum(counts)])[bounds]
        ids = self.ids[places(self.word_ends[number], counts)]
        if long:
            self.forget()
        return ids, bounds

    def _learn(self, new: list[bytes]) -> bool:
        """Number new pieces and their pre-tokens; whether there is a long one."""
        cut = [(p,) if p.isascii() and p[p[:1] == b" ":].isalpha() else
               tuple(w.encode() for w in self.split(p.decode())) for p in new]
        fresh = sorted(set(chain.from_iterable(cut)).difference(self.words))
        ids, counts = self.encoder.encode_together(fresh)
        first = len(self.words)
        self.words.update(zip(fresh, range(first, first + len(fresh))))
        self.ids = np.concatenate([self.ids, ids])
        self.word_ends = np.append(self.word_ends, self.word_ends[-1] + np.cumsum(counts))
        inside = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int32)
        first = len(self.pieces)
        self.pieces.update(zip(new, range(first, first + len(new))))
        self.inside = np.concatenate([self.inside, inside])
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        self.piece_ends = np.append(self.piece_ends, self.piece_ends[-1] + np.cumsum(counts))
        return any(len(p) > LONG for p in new)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Bytes of the ids of each text."""
        tokens = self.tokens.take(pa.array(ids))
        _, ends, held = tokens.buffers()
        ends = np.frombuffer(ends, np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
            None, pa.py_buffer(ends[bounds]), pa.py_buffer(b"") if held is None else held])


SCHEMA = "doc_id {}, ids array<int>, decoded binary"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (token ids of the text), decoded (bytes of those ids).

    Each match of `pattern` is encoded separately, without special tokens. Null counts as the
    empty text, which has no tokens. Repeated rows and null ids are encoded like any other. Other
    columns of `docs` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shipped = shared(spark, TextEncoder(token_tables(read_ranks(ranks_path)), pattern))
    rows = id_and_bytes(docs, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.kept
        for part in byte_slices(batches):
            ids, bounds = encoder.encode(part.column("text"))
            yield pa.record_batch([
                part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                encoder.decode(ids, bounds)], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(encode, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    ids = F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(","))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
