"""Token counts under a unigram model, with one forward pass for all words that share a prefix.

The distinct pre-tokens of a slice of documents go into a byte trie. The forward score of a node is
the best total score of any cut of its prefix into pieces; it needs only the nodes above it, so it
is worked out once however many words pass through. The number of tokens of the best cut stands at
the node where a word ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from catalink.llm.pretokens import (REMEMBERED, id_and_text, lengths_by_end, pieces, read_ranks,
                                    shared, slices, splitter)

#: Scores are whole millionths of a natural logarithm, so sums do not depend on their order.
UNIT = 1_000_000
#: Bytes of a word that become nodes of the trie, and longest word that is remembered.
LONG = 64


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Unigram scores of a rank file: the probability of a token falls as 1 / (rank + 1)."""
    total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {t: -round(UNIT * (math.log(rank + 1) + total)) for t, rank in ranks.items()}


class Trie:
    """Nodes with the best forward score of their prefix and its number of tokens."""

    def __init__(self, scores: dict[bytes, int]):
        self.pieces, self.ends = scores, lengths_by_end(scores)
        self.reach = max(map(len, scores), default=1)
        self.child: dict[tuple[int, int], int] = {}
        self.score, self.tokens = [0], [0]

    def insert(self, word: bytes) -> int:
        """Terminal count of a word; ties between cuts go to the one of fewer tokens.

        Only the first LONG bytes of a word become nodes. Behind them the same scores run on by
        position, as many as the longest piece reaches back, so memory does not grow with the word.
        """
        child, score, tokens, known = self.child, self.score, self.tokens, self.pieces
        path, node = [0], 0
        for i, byte in enumerate(word[:LONG], 1):
            after = child.get((node, byte))
            if after is None:
                above = path[-1]
                best = score[above] + known[word[i - 1:i]], -tokens[above] - 1
                for n in self.ends.get(word[i - 2:i], ()):
                    if n <= i and (gain := known.get(word[i - n:i])) is not None:
                        above = path[i - n]
                        best = max(best, (score[above] + gain, -tokens[above] - 1))
                after = child[node, byte] = len(score)
                score.append(best[0])
                tokens.append(-best[1])
            path.append(after)
            node = after
        if len(word) <= LONG:
            return tokens[node]
        reach = self.reach
        held = [(score[p], -tokens[p]) for p in path]  # of the latest prefixes, shortest first
        for i in range(LONG + 1, len(word) + 1):
            best = held[-1][0] + known[word[i - 1:i]], held[-1][1] - 1
            for n in self.ends.get(word[i - 2:i], ()):
                if n <= i and (gain := known.get(word[i - n:i])) is not None:
                    best = max(best, (held[-n][0] + gain, held[-n][1] - 1))
            held.append(best)
            if len(held) > 4 * reach:
                del held[:-reach]
        return -held[-1][1]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_pretokens, n_tokens.

    Every byte must be a piece of its own, so any text can be cut. Null counts as the empty text,
    which has no tokens. Repeated rows and null ids are counted like any other. A very long text
    comes alone, and of a very long pre-token only the beginning is kept in the trie. Other columns
    of `docs` are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scores = shared(spark, zipf_scores(read_ranks(ranks_path)))
    rows = id_and_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, trie = splitter(pattern), Trie(scores.value)
        words: dict[str, int] = {}
        seen: dict[str, tuple[int, int]] = {}
        for ids, texts in slices(batches):
            if len(trie.score) > 4 * REMEMBERED:
                trie = Trie(scores.value)
            if len(words) > REMEMBERED:
                words = {}
            if len(seen) > REMEMBERED:
                seen = {}
            cut = [pieces(t) for t in texts]
            parts = {p: split(p) for p in set().union(*cut).difference(seen)}
            long: dict[str, int] = {}
            for word in sorted(set().union(*parts.values()).difference(words)):
                (words if len(word) <= LONG else long)[word] = trie.insert(word.encode())
            found = {p: (len(x), sum(words[w] if w in words else long[w] for w in x))
                     for p, x in parts.items()}
            seen.update((p, x) for p, x in found.items() if len(p) < 64)
            counts = [[seen.get(p) or found[p] for p in x] for x in cut]
            yield pa.record_batch([
                ids, pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([sum(n for n, _ in x) for x in counts], pa.int64()),
                pa.array([sum(n for _, n in x) for x in counts], pa.int64())],
                ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
