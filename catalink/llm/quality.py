"""Quality of a text: histogram gradient-boosted trees over document statistics.

The statistics are read from the bytes, words and lines of the whole text. Trees are grown on
binned statistics of a bounded sample of labelled documents (SAMPLE_ROWS, documented bound), level
by level from histograms of gradients, and flattened into arrays: all documents of a batch walk
down a tree together with numpy indexing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.folds import fold
from catalink.llm.pretokens import shared
from catalink.llm.textbytes import unused

#: Bound of the training sample, in documents.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 8
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 blank, 5 stop, 6 high
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = (6 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else
                 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:!?'\"-()" else 0)
STATISTICS = (
    "log_bytes", "lower", "upper", "digits", "blanks", "punctuation", "high", "symbols",
    "most_common_symbol", "byte_entropy", "word_length", "word_deviation", "distinct_words",
    "most_common_word", "single_letters", "long_words", "ends_in_symbol", "line_words",
    "repeated_lines", "ends_of_sentence", "bars", "exclamations")


def statistics(text: str | None) -> list[float]:
    """The statistics of a text; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=bytes_, minlength=7) / len(data)
    symbols = np.where(_KIND == 0, bytes_, 0)
    share = bytes_[bytes_ > 0] / len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    ends = np.bincount([x[-1] for x in words], minlength=256) if words else np.zeros(256)
    return [
        float(np.log1p(len(data))), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        kinds[0], symbols.max() / len(data), float(-(share * np.log2(share)).sum()),
        float(lengths.mean()), float(lengths.std()), len(counts) / n,
        max(counts.values(), default=0) / n, float((lengths == 1).sum()) / n,
        float((lengths > 20).sum()) / n, float(ends[_KIND == 0].sum()) / n,
        n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        float(ends[[33, 46, 63]].sum()) / n, bytes_[124] / len(data), bytes_[33] / len(data)]


@dataclass
class Forest:
    """Flattened trees: nodes of all trees in common arrays; a leaf leads back to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                beyond = x[rows, self.feature[node]] > self.limit[node]
                node = np.where(beyond, self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting with logistic loss; without rows of both labels the forest is a constant."""
    n, width = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
                 for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], axis=1)
        offset = np.arange(width) * BINS
        margin = np.full(n, np.log(positive / (1 - positive)))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, 0, 0, 0.0])
            open_nodes = [(len(nodes) - 1, np.arange(n))]
            for depth in range(DEPTH + 1):
                following = []
                for at, rows in open_nodes:
                    g, h = gradient[rows].sum(), curve[rows].sum()
                    nodes[at][2:] = [at, at, RATE * g / (h + RIDGE)]
                    if depth == DEPTH or len(rows) < 2 * LEAST:
                        margin[rows] += nodes[at][4]
                        continue
                    cells = (binned[rows] + offset).ravel()
                    gs, hs, ns = (np.bincount(cells, weights=w, minlength=width * BINS)
                                  .reshape(width, BINS).cumsum(axis=1)[:, :-1]
                                  for w in (np.repeat(gradient[rows], width),
                                            np.repeat(curve[rows], width),
                                            np.ones(len(cells))))
                    gain = gs ** 2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE)
                    gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -np.inf
                    f, cut = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, cut] <= g ** 2 / (h + RIDGE) + 1e-9:
                        margin[rows] += nodes[at][4]
                        continue
                    beyond = binned[rows, f] > cut
                    nodes[at][:4] = [f, edges[f][cut], len(nodes), len(nodes) + 1]
                    nodes += [[0, np.inf, 0, 0, 0.0], [0, np.inf, 0, 0, 0.0]]
                    following += [(len(nodes) - 2, rows[~beyond]), (len(nodes) - 1, rows[beyond])]
                open_nodes = following
    flat = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    whole = [flat[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Forest(whole[0], flat[:, 1], whole[1], whole[2], flat[:, 4],
                  np.array(roots, dtype=np.int64), float(np.log(positive / (1 - positive))))


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return measure(text.cast("string"))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", folds: int = 5,
                  held_out: int = 0) -> Forest:
    """A forest from labelled documents outside the held-out fold.

    The sample is drawn from the labels first, so only its documents are read further. Rows
    without a label teach nothing.
    """
    own, label = unused("label_id", docs), unused("label_value", docs)
    known = labels.filter((fold(id_col, folds) != held_out)
                          & F.col(f"`{label_col}`").isin(0, 1)).select(
        F.col(f"`{id_col}`").alias(own), F.col(f"`{label_col}`").cast("int").alias(label))
    n = max(known.count(), 1)
    drawn = known.filter(F.pmod(F.xxhash64(own), F.lit(n)) < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS)
    text = F.col(f"`{text_col}`")
    sample = (docs.join(F.broadcast(drawn), F.col(f"`{id_col}`") == F.col(own))
              .select(F.col(own).alias("id"), F.col(label).alias("label"),
                      statistics_of(text).alias("x"))
              .limit(2 * SAMPLE_ROWS).collect())
    sample.sort(key=lambda r: (r.id, r.label, r.x))
    x = np.array([r.x for r in sample], dtype=np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r.label for r in sample], dtype=np.float64))


def quality_of(docs: DataFrame, forest: Forest, text_col: str = "text") -> Column:
    """Probability of label 1 for each whole text, null and empty texts included."""
    held = shared(docs.sparkSession, forest)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(held.value.scores(x))

    return score(F.col(f"`{text_col}`").cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", folds: int = 5,
                  held_out: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score of 0.3 or more).

    Equal texts get equal scores, in repeated rows too; null and empty texts have the statistics of
    no bytes, very long ones are measured whole. Other columns of `docs` are ignored, whatever their
    names; an empty table gives an empty result; without labels the score is that of the prior.
    """
    forest = fit_documents(docs, labels, id_col, text_col, label_col, folds, held_out)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"),
        quality_of(docs, forest, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
