"""Language of a text from averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte n-grams, words marked by blanks. The model is
trained in numpy on a bounded sample of labelled documents: ROWS_PER_LANGUAGE rows of each
language, fewer where there are many languages, a window of SAMPLE_CHARS characters of each. A fifth of the sample calibrates it: a
temperature for the probabilities, the probability under which a prediction is rejected, and the
share of n-grams met in training under which a text is of no language that was learned.
Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.folds import fold
from catalink.llm.pretokens import shared

#: Bounds of the training sample; very many languages still have LEAST_ROWS rows each.
ROWS_PER_LANGUAGE, SAMPLE_CHARS, MOST_ROWS, LEAST_ROWS = 1500, 1500, 300_000, 20
BUCKET_BITS, WIDTH, EPOCHS, RATE = 18, 12, 4, 0.5
#: Share of calibration texts of a length that each bound may reject, and the shortest cut of one.
REJECTED, SHORTEST = 0.001, 8
#: Bytes hashed at a time.
WINDOW = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def subwords(text: str):
    """Buckets of the 2-, 3- and 4-byte n-grams of a text, a window at a time."""
    clean = b" " + b" ".join(text.lower().encode().translate(_BLANKS).split()) + b" "
    for start in range(0, max(1, len(clean) - 3), WINDOW):
        x = np.frombuffer(clean, np.uint8, min(len(clean) - start, WINDOW + 3), start)
        x = x.astype(np.uint32)
        grams = [x[:-1] * np.uint32(257) + x[1:]]
        for n in (2, 3):
            grams.append(grams[-1][:-1] * np.uint32(263) + x[n:])
        found = np.concatenate(grams) * np.uint32(2654435761)
        yield found >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    """Log-odds of each bucket for each language, and last whether training met the bucket.

    With more languages than WIDTH the table holds the embeddings instead, and `out` their weights.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Least probability and least known share of texts of 2^i n-grams and more.
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))
    out: np.ndarray | None = None

    def scores(self, text: str) -> tuple[np.ndarray, float, int]:
        """Log-odds of the languages, the share of known n-grams and the number of n-grams."""
        total, n = np.zeros(self.table.shape[1]), 0
        for found in subwords(text):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        total /= max(n, 1)
        z = total[:-1] if self.out is None else total[:-1] @ self.out
        return z + self.bias, float(total[-1]), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        z, known, n = self.scores(text)
        z = z / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        threshold, least_known = self.bounds[min(n.bit_length(), len(self.bounds)) - 1]
        return (self.languages[best], float(p[best]),
                bool(p[best] >= threshold and known >= least_known))


def cuts(text: str) -> list[str]:
    """A text, and pieces of whole words from it, each at most twice as long as the one before."""
    out, body, size = [text], text.split(None, 1)[-1] if text.strip() else "", SHORTEST
    while size < len(body):
        words = body[:size + 1].rsplit(None, 1)
        if len(words) > 1 and _LETTER.search(words[0]):
            out.append(words[0])
        size *= 2
    return out


def bounds_by_length(sizes: np.ndarray, values: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each doubling of the size, the REJECTED quantiles of the columns of `values`.

    The first column counts where the prediction is right. Lengths that follow each other are
    taken together until they have enough texts for such a quantile, a rest with those before it.
    """
    level = np.array([int(n).bit_length() - 1 for n in sizes])
    out, low = np.zeros((level.max() + 1, 2)), 0
    for high in range(1, len(out) + 1):
        own, rest = (level >= low) & (level < high), (level >= high).sum()
        if rest and min(own.sum(), rest) < 1 / REJECTED:
            continue
        for k, rows in enumerate((own & right, own)):
            if rows.any():
                out[low:high, k] = np.quantile(values[rows, k], REJECTED, method="lower")
        low = high
    return out


def learned(counted: list, target: np.ndarray, learn: np.ndarray, languages: list[str],
            rng: np.random.Generator) -> Model:
    """Stochastic gradient descent over the texts `learn`, one at a time; not calibrated."""
    table = np.zeros((1 << BUCKET_BITS, WIDTH), np.float32)
    out = rng.normal(0, 0.5, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            found, n = counted[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[found]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            rate = RATE * (1 - step / steps)
            # the mean spreads a step over many rows, so rows take it scaled by their number
            table[found] -= rate * len(found) ** 0.5 * np.outer(share, out @ p)
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            step += 1
    met = np.zeros((len(table), 1), np.float32)
    for i in learn:
        met[counted[i][0]] = 1
    bias = bias.astype(np.float64)
    if len(languages) > WIDTH:
        return Model(languages, np.hstack([table, met]), bias, out=out)
    return Model(languages, np.hstack([table @ out, met]), bias)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model of four fifths of the texts, calibrated on the others.

    If these are too few for the REJECTED quantile, each other fifth is scored in its turn by a
    model of the rest, so that all texts count for the bounds.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    counted = [np.unique(np.concatenate(list(subwords(x))), return_counts=True) for x in texts]
    fifths = [order[k::5] for k in range(5)]
    rests = [np.array([i for k, i in enumerate(order) if k % 5 != f], np.int64) for f in range(5)]
    model = learned(counted, target, order if len(order) < 10 else rests[0], languages, rng)
    z, own = np.array([model.scores(texts[i])[0] for i in fifths[0]]), target[fifths[0]]

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), own]))

    model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    pieces = []
    for f in range(5 if len(fifths[0]) < 1 / REJECTED else 1):
        if len(rests[f]) and len(fifths[f]):
            other = model if f == 0 and len(order) >= 10 else learned(
                counted, target, rests[f], languages, rng)
            pieces += [(*other.scores(x), target[i]) for i in fifths[f] for x in cuts(texts[i])
                       if _LETTER.search(x)]
    if pieces:
        scores, known, sizes, own = zip(*pieces)
        s = np.array(scores) / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        model.bounds = bounds_by_length(np.array(sizes), np.stack([p.max(axis=1), known], axis=1),
                                        p.argmax(axis=1) == own)
    return model


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                    folds: int, held_out: int) -> DataFrame:
    """Bounded sample of labelled windows: text, lang."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.filter((fold(id_col, folds) != held_out) & lang.isNotNull()
                       & text.isNotNull() & (lang != UNKNOWN)).select(
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("pick"), text.alias("text"),
        lang.cast("string").alias("lang"))
    known = rows.groupBy("lang").count()
    n = max(known.count(), 1)
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, MOST_ROWS // n))
    start = F.pmod("pick", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    return (rows.join(F.broadcast(known), "lang")
            .filter(F.pmod(F.col("pick"), F.col("count")) < each)
            .select("lang", F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS))
                    .alias("text"))
            .limit(2 * max(MOST_ROWS, n * each)))


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> Model:
    """A model from documents outside the held-out fold; rows without text or lang teach nothing."""
    rows = training_sample(docs, id_col, text_col, lang_col, folds, held_out).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def language_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct of lang, score and accepted for each whole text.

    `und` with score 0, not accepted, if the text is null or has no letter or nothing was learned.
    """
    held = shared(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts],
                            columns=["lang", "score", "accepted"])

    return predict(F.col(f"`{text_col}`").cast("string"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, accepted.

    score is the calibrated probability of lang_pred. Repeated rows are predicted like any other,
    ties go to the language first in order; an empty table gives an empty result; other columns
    of `docs` are ignored.
    """
    model = fit_documents(docs, id_col, text_col, lang_col, folds, held_out)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"),
        language_of(docs, model, text_col).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score",
        "found.accepted")


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is told with enough confidence, all columns kept."""
    model = fit_documents(docs, id_col, text_col, lang_col)
    return docs.filter(language_of(docs, model, text_col)["accepted"])
