"""Log probability of texts under a hashed maximum-entropy model with a class-factored softmax.

Counts of all training tokens are made by Spark over blocks of documents. The FREQUENT most
frequent tokens form classes of CLASS words; all others fall into classes by the magnitude of their
count, down to the class of tokens never seen. A softmax over classes, and one over the words of a
frequent class, have hashed features of the two tokens before: the last one, both, and the one
before the last alone (a skip). Inside a class by count, a token has its share of the (count + 1)
of that class, so every known token and one unseen event share a probability of 1.

Training is distributed: each task walks its blocks with Adagrad steps from the common weights;
the changes are averaged row by row, weighted by how often each task met the row, in a tree of
bounded groups. Scoring is sparse: three gathered rows a token, in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm import blocks as packing
from catalink.llm.folds import fold
from catalink.llm.hashing import mix, word_hashes
from catalink.llm.pretokens import shared
from catalink.session import landed

CLASS, FREQUENT, LEVELS = 16, 256, 12
CLASSES = FREQUENT // CLASS + LEVELS
ROW_BITS = 15
#: Tokens a step, step size of Adagrad, passes over disjoint halves of the blocks.
BATCH, STEP, ROUNDS = 1 << 14, 0.3, 2
#: Rows of the weight tables averaged together, and changes added up in one group.
SLICE, GROUP = 512, 32
#: Bits of a unit, under those of its class by the count in other documents; KEPT: same unit.
UNIT_BITS, KEPT = 10, 15

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = mix(np.array([0x656E64], np.uint64))[0]


def block_tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block, an end after each document, and the number of each document."""
    body = packing.body(row)
    sizes = np.array(row["sizes"], np.int64)
    # a blank between documents, so that no word runs across
    ends = np.cumsum(sizes)
    joined = b"\n".join(body[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist()))
    starts, hashes = word_hashes(joined.translate(_LOWER), _BLANK)
    borders = np.searchsorted(starts, ends + np.arange(len(sizes)))
    counts = np.diff(np.append(0, borders)) + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    place = np.arange(len(starts)) + np.searchsorted(borders, np.arange(len(starts)), side="right")
    out[place] = hashes
    return out, counts


def level(count: np.ndarray) -> np.ndarray:
    """Class by count: 0 for none, then one for each doubling, the last open."""
    return np.minimum(np.ceil(np.log2(count.astype(np.float64) + 1)).astype(np.int64), LEVELS - 1)


def count_tokens(held: DataFrame, bits: int) -> DataFrame:
    """Training counts for each block and range: block, part, counts, and once a range its sums."""
    asked = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary()),
                       ("counts", pa.binary())])

    def ask(row: dict) -> Iterator[dict]:
        tokens, sizes = block_tokens(row)
        train = np.repeat(~np.array(row["flags"], bool), sizes)
        kinds, inverse = np.unique(tokens, return_inverse=True)
        counts = np.bincount(inverse[train], minlength=len(kinds)).astype(np.int32)
        for part, own in packing.by_range(kinds, bits):
            yield {"block": row["block"], "part": part, "hashes": kinds[own].tobytes(),
                   "counts": counts[own].tobytes()}

    answered = pa.schema([
        ("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()),
        ("tokens", pa.int64()), ("types", pa.int64()), ("level_tokens", pa.list_(pa.int64())),
        ("level_types", pa.list_(pa.int64())),
        ("top", pa.list_(pa.struct([("hash", pa.int64()), ("count", pa.int64())])))])

    def answer(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        asks = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        own = np.concatenate([np.frombuffer(x, np.int32)
                              for x in table.column("counts").to_pylist()])
        kinds, inverse = np.unique(np.concatenate(asks), return_inverse=True)
        total = np.bincount(inverse, weights=own, minlength=len(kinds)).astype(np.int64)
        seen = total > 0
        levels = level(total)
        top = np.lexsort((kinds, -total))[:FREQUENT]
        top = top[seen[top]]
        out, at = [], 0
        for i, x in enumerate(asks):
            counts = total[inverse[at:at + len(x)]]
            at += len(x)
            first = i == 0
            out.append({
                "block": table.column("block")[i].as_py(), "part": table.column("part")[i].as_py(),
                "counts": counts.tobytes(), "tokens": int(total.sum()) if first else 0,
                "types": int(seen.sum()) if first else 0,
                "level_tokens": np.bincount(levels, weights=total, minlength=LEVELS)
                .astype(np.int64).tolist() if first else None,
                "level_types": np.bincount(levels[seen], minlength=LEVELS).tolist()
                if first else None,
                "top": [{"hash": int(kinds[k].astype(np.int64)), "count": int(total[k])}
                        for k in top] if first else None})
        return pa.Table.from_pylist(out, answered)

    return landed(
        held.select("block", "flags", "sizes", "n_bytes", "body")
        .mapInArrow(packing.map_rows(ask, asked), "block long, part long, hashes binary, counts binary")
        .groupBy("part").applyInArrow(
            answer, "block long, part long, counts binary, tokens long, types long, "
                    "level_tokens array<long>, level_types array<long>, "
                    "top array<struct<hash:long,count:long>>"), "counts")


class Vocabulary:
    """Sums over the training tokens; classes of tokens. Its size is fixed by the settings."""

    def __init__(self, counts: DataFrame):
        sums = counts.agg(
            F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)),
            *[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for c in ("level_tokens", "level_types")
              for i in range(LEVELS)]).first()
        self.tokens, self.types = sums[0], sums[1]
        top = (counts.filter("top is not null").select(F.explode("top").alias("t"))
               .orderBy(F.desc("t.count"), "t.hash").limit(FREQUENT).select("t.*").collect())
        self.words = np.array([r["hash"] for r in top], np.int64).astype(np.uint64)
        self.counts = np.array([r["count"] for r in top], np.int64)
        own = level(self.counts)
        tokens = np.array(sums[2:2 + LEVELS]) - np.bincount(own, self.counts, LEVELS)
        types = np.array(sums[2 + LEVELS:]) - np.bincount(own, minlength=LEVELS)
        types[0] = 1  # all unseen tokens are one event
        self.shares = np.maximum(tokens + types, 1)
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def units(self, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token kind, and log10 of its share inside a class by count."""
        levels = level(counts)
        unit = FREQUENT + levels
        share = np.log10((counts + 1) / self.shares[levels])
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, kinds), len(self.sorted) - 1)
            frequent = self.sorted[at] == kinds
            unit = np.where(frequent, self.order[at], unit)
            share[frequent] = 0.0
        return unit, share

    def start(self) -> dict[str, np.ndarray]:
        """Weights of the model that knows no context."""
        of_words = np.zeros(FREQUENT)
        of_words[:len(self.counts)] = self.counts
        masses = np.concatenate([of_words.reshape(-1, CLASS).sum(axis=1), self.shares])
        missing = np.where(np.arange(FREQUENT) < len(self.counts), 0.0, -1e4)
        return {
            "class_bias": np.log(masses + 0.5).astype(np.float32),
            "word_bias": (np.log(of_words + 0.5) + missing).reshape(-1, CLASS).astype(np.float32),
            "class_rows": np.zeros((1 << ROW_BITS, CLASSES), np.float32),
            "word_rows": np.zeros((1 << ROW_BITS, CLASS), np.float32)}


def unit_blocks(held: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """Blocks as units: block, ids, flags, sizes, known, base, tail, units, context."""
    fixed = shared(held.sparkSession, words)
    kind = held.schema["ids"].dataType.simpleString()
    numbers = pa.list_(pa.float64())

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        words, out = fixed.value, []
        right = right.sort_by("part")
        answers = [np.frombuffer(x, np.int64) for x in right.column("counts").to_pylist()]
        schema = pa.schema([
            ("block", pa.int64()), ("ids", left.schema.field("ids").type),
            ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
            ("known", pa.list_(pa.int64())), ("base", numbers), ("tail", numbers),
            ("units", pa.binary()), ("context", pa.binary())])
        for row in packing.rows_of(left):
            tokens, sizes = block_tokens(row)
            kinds, inverse = np.unique(tokens, return_inverse=True)
            total = np.concatenate(answers)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            unit, share = words.units(kinds, total)
            base = np.log10((total + 1) / (words.tokens + words.types + 1))
            # training sees a rare token with the count that other documents give it
            pair = owner * len(kinds) + inverse
            _, at, n = np.unique(pair, return_inverse=True, return_counts=True)
            elsewhere = level(np.maximum(total[inverse] - n[at], 0))
            elsewhere[unit[inverse] < FREQUENT] = KEPT
            units = (unit[inverse] | elsewhere << UNIT_BITS).astype(np.uint16)
            context = np.maximum(kinds >> np.uint64(48), np.uint64(1)).astype(np.uint16)[inverse]
            doc = [np.bincount(owner, weights=w[inverse], minlength=len(sizes))
                   for w in (total > 0, base, share)]
            out.append({
                "block": row["block"], "ids": row["ids"], "flags": row["flags"],
                "sizes": sizes.tolist(), "known": doc[0].astype(np.int64).tolist(),
                "base": doc[1].tolist(), "tail": doc[2].tolist(),
                "units": pa.compress(units.tobytes(), codec="zstd", asbytes=True),
                "context": pa.compress(context.tobytes(), codec="zstd", asbytes=True)})
        return pa.Table.from_pylist(out, schema)

    return landed(
        held.groupBy("block").cogroup(counts.select("block", "part", "counts").groupBy("block"))
        .applyInArrow(join, f"block long, ids {kind}, flags array<boolean>, sizes array<long>, "
                            "known array<long>, base array<double>, tail array<double>, "
                            "units binary, context binary"), "units")


def hashed(a: np.ndarray, salt: int) -> np.ndarray:
    h = (a.astype(np.uint32) + np.uint32(salt)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(2246822519)) >> np.uint32(32 - ROW_BITS)


class Walk:
    """Targets and feature rows of a block's tokens."""

    def __init__(self, row: dict, training: bool):
        n = int(sum(row["sizes"]))
        read = (np.frombuffer(pa.decompress(row[k], 2 * n, codec="zstd", asbytes=True), np.uint16)
                for k in ("units", "context"))
        units, context = next(read), next(read).astype(np.uint32)
        sizes = np.array(row["sizes"])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        one[1:] = context[:-1]
        two[2:] = context[:-2]
        one[place < 1] = 0
        two[place < 2] = 0
        elsewhere = (units >> np.uint16(UNIT_BITS)).astype(np.int64)
        unit = (units & np.uint16((1 << UNIT_BITS) - 1)).astype(np.int64)
        if training:
            learn = ~np.array(row["flags"], bool)[self.owner]
            unit = np.where(elsewhere == KEPT, unit, FREQUENT + elsewhere)[learn]
            one, two = one[learn], two[learn]
        word = unit < FREQUENT
        self.target = np.where(word, unit // CLASS, FREQUENT // CLASS + unit - FREQUENT)
        self.rows = np.stack([hashed(one, 1), hashed(one * np.uint32(40503) + two, 2),
                              hashed(two, 3)])
        self.at = np.flatnonzero(word)
        own = self.target[self.at].astype(np.uint32) << np.uint32(20)
        self.word = unit[self.at] % CLASS
        self.word_rows = np.stack([
            hashed(one[self.at] + own, 4),
            hashed(one[self.at] * np.uint32(40503) + two[self.at] + own, 5)])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_logits(w: dict, rows: np.ndarray) -> np.ndarray:
    return w["class_bias"] + sum(w["class_rows"][r] for r in rows)


def word_logits(w: dict, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    return w["word_bias"][own] + sum(w["word_rows"][r] for r in rows)


class Trainer:
    """Adagrad from common weights; remembers how often each row was met."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.square = {k: np.ones(v.shape, np.float32) for k, v in weights.items()}
        self.met = {k: np.zeros(len(v), np.int64) for k, v in weights.items()}

    def step(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        """rows: one line of row numbers for each feature; all get the same gradient."""
        table, square = self.w[name], self.square[name]
        width = table.shape[1]
        met = sum(np.bincount(r, minlength=len(table)) for r in rows)
        self.met[name] += met
        own = np.flatnonzero(met)  # sums are made for these rows alone
        place = np.zeros(len(table), np.int64)
        place[own] = np.arange(len(own)) * width
        weights, total = gradient.ravel(), np.zeros(len(own) * width)
        for r in rows:
            cells = (place[r][:, None] + np.arange(width)).ravel()
            total += np.bincount(cells, weights=weights, minlength=len(total))
        g = total.astype(np.float32).reshape(-1, width)
        squares = square[own] + g * g
        square[own] = squares
        table[own] -= STEP * g / np.sqrt(squares)

    def learn(self, row: dict) -> None:
        walk = Walk(row, True)
        for a in range(0, len(walk.target), BATCH):
            rows, target = walk.rows[:, a:a + BATCH], walk.target[a:a + BATCH]
            p = np.exp(log_softmax(class_logits(self.w, rows)))
            p[np.arange(len(target)), target] -= 1
            self.step("class_rows", rows, p)
            low, high = np.searchsorted(walk.at, (a, a + BATCH))
            if low < high:
                rows, word = walk.word_rows[:, low:high], walk.word[low:high]
                own = walk.target[walk.at[low:high]]
                p = np.exp(log_softmax(word_logits(self.w, rows, own)))
                p[np.arange(len(word)), word] -= 1
                self.step("word_rows", rows, p)


def train(units: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One pass over all training tokens, in ROUNDS halves with averaged weights between."""
    spark = units.sparkSession
    names = ("class_rows", "word_rows")
    change = pa.schema([("name", pa.string()), ("slice", pa.int64()), ("member", pa.int64()),
                        ("met", pa.binary()), ("moved", pa.binary())])
    columns = "name string, slice long, member long, met binary, moved binary"

    def one_round(number: int, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        fixed = shared(spark, weights)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = fixed.value
            trainer, any_block = Trainer(start), False
            for batch in batches:
                for row in packing.rows_of(batch):
                    trainer.learn(row)
                    any_block = True
            if not any_block:
                return
            member = TaskContext.get().partitionId()
            for name in names:
                moved = (trainer.w[name] - start[name]) * trainer.met[name][:, None]
                for s in range(0, len(moved), SLICE):
                    met = trainer.met[name][s:s + SLICE]
                    yield pa.RecordBatch.from_pylist([{
                        "name": name, "slice": s, "member": member, "met": met.tobytes(),
                        "moved": moved[s:s + SLICE].astype(np.float32).tobytes()}], change)

        def add(table: pa.Table) -> pa.Table:
            row = table.slice(0, 1).to_pylist()[0]
            order = np.argsort(table.column("member").to_numpy(), kind="stable").tolist()
            met, moved = table.column("met"), table.column("moved")
            row["met"] = sum(np.frombuffer(met[i].as_py(), np.int64) for i in order).tobytes()
            row["moved"] = sum(np.frombuffer(moved[i].as_py(), np.float32).astype(np.float64)
                               for i in order).astype(np.float32).tobytes()
            row["member"] //= GROUP
            return pa.Table.from_pylist([row], change)

        parts = units.filter((F.col("block") % ROUNDS == number)
                             & F.exists("flags", lambda f: ~f)).select(
            "block", "flags", "sizes", "units", "context")
        total = landed(parts.mapInArrow(walk, columns), "changes")
        while (total.agg(F.max("member")).first()[0] or 0) > 0:
            total = landed(total.groupBy("name", "slice", F.floor(F.col("member") / GROUP).alias("g"))
                           .applyInArrow(add, columns), "changes")
        after = {k: v.copy() for k, v in weights.items()}
        for r in total.toLocalIterator():
            met = np.frombuffer(r.met, np.int64)
            moved = np.frombuffer(r.moved, np.float32).reshape(len(met), -1)
            after[r.name][r.slice:r.slice + SLICE] += moved / np.maximum(met, 1)[:, None]
        return after

    for number in range(ROUNDS):
        weights = one_round(number, weights)
    return weights


def score_blocks(units: DataFrame, weights: dict[str, np.ndarray], words: Vocabulary) -> DataFrame:
    fixed = shared(units.sparkSession, weights)
    kind = units.schema["ids"].dataType.elementType.simpleString()
    tokens = words.tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fixed.value
        for batch in batches:
            for i, row in enumerate(packing.rows_of(batch)):
                walk = Walk(row, False)
                logs = np.empty(len(walk.target))
                for a in range(0, len(logs), BATCH):
                    target = walk.target[a:a + BATCH]
                    z = log_softmax(class_logits(w, walk.rows[:, a:a + BATCH]))
                    logs[a:a + BATCH] = z[np.arange(len(target)), target]
                for a in range(0, len(walk.at), BATCH):
                    at, word = walk.at[a:a + BATCH], walk.word[a:a + BATCH]
                    z = log_softmax(word_logits(w, walk.word_rows[:, a:a + BATCH],
                                                walk.target[at]))
                    logs[at] += z[np.arange(len(at)), word]
                n = len(row["sizes"])
                total = np.bincount(walk.owner, weights=logs, minlength=n) / np.log(10)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.record_batch([
                    ids, pa.array(row["flags"], pa.bool_()), pa.array(row["sizes"], pa.int64()),
                    pa.array(row["known"], pa.int64()), pa.array([tokens] * n, pa.int64()),
                    pa.array(row["base"], pa.float64()),
                    pa.array(total + np.array(row["tail"]), pa.float64())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score"])

    return units.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
               "train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents outside the held-out fold. Null counts as the empty text, which is
    one end token. base_score: add-one probability of the single tokens; score: that of the model,
    both as log10 of the whole text. Repeated rows count and are scored like any other. If nothing
    is held in training, all tokens are the unseen event. Other columns of `docs` are ignored; an
    empty table gives an empty result.
    """
    held = packing.packed(docs, id_col, text_col, fold(id_col, folds) == held_out)
    counts = count_tokens(held, packing.range_bits(held))
    words = Vocabulary(counts)
    units = unit_blocks(held, counts, words)
    return score_blocks(units, train(units, words.start()), words)
