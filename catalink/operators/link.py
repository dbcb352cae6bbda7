"""Linking by cosine similarity of term weights.

Each post keeps the single item most similar to it. Scoring every (post, item) pair as
rows would shuffle one row per pair that shares any term, so the item side becomes an
inverted index instead: when its measured size is within ``INDEX_ENTRIES`` it is shipped,
whatever the size of the vocabulary,
to the tasks and each Arrow batch of posts is scored where it lies, with no shuffle and
no pair rows. A larger item side is cut into as many indexes by its ids, and each post keeps its
best of every one: without a threshold nearly all pairs share some term, so no pair is written.
Above a threshold it is joined on terms by Spark: an item's frequent terms that
cannot decide a link above the threshold are left out of the join, hot terms are salted and
products are added up on the map side first. All ways give the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from catalink.functions.ids import row_key
from catalink.functions.text import term_runs
from catalink.operators.joins import lookup_join
from catalink.operators.vectorize import TermModel, exploded_runs, run_parts
from catalink.session import landed

# Entries of the shipped index: 12 bytes each, so at most about 100 MB per Python worker.
INDEX_ENTRIES = 8_000_000
# Terms of a vocabulary that is shipped with the index; of a larger one only the items' terms are.
INDEX_TERMS = 1_000_000
# Cells of one score block inside a task (8 bytes each); a block of postings that stays in the caches.
BLOCK_CELLS = 4_000_000
SCORE_CELLS = 500_000
# Similarities of posts and items that one task works out at most, unless a post has more of them.
TASK_CELLS = 1_000_000_000
# Similarities are compared at this many decimals so that ties do not hang on the
# order in which floating-point products were added.
DECIMALS = 9
# Similarities of the true item and of all items are added up in two ways that may round apart.
APART = 1.5 * 10.0 ** -DECIMALS
# Slack of the pruning bounds, far above rounding errors of the sums.
MARGIN = 1e-6
# Rows of one term that a single task joins before the term is salted.
ROWS_PER_SALT = 1_000_000


# An inverted index over unit-length item vectors, items in id order: ``items``, ``terms``
# (an Arrow array) and ``idf`` by idx, ``partial`` if terms are missing, and the postings ``columns`` and ``values`` of idx i from
# ``starts[i]`` to ``starts[i + 1]``. A plain namespace, because broadcasts travel by reference.
ItemIndex = SimpleNamespace


def item_weights(items: DataFrame, key: str, model: TermModel, min_active: int = 0) -> DataFrame:
    """Unit-length long weights of the items: (key, term, idx, doc_freq, weight)."""
    rows = model.weights(items.select(key, "terms"))
    norms = rows.groupBy(key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.count(F.lit(1)).alias("active"),
    ).where((F.col("active") >= min_active) & (F.col("norm") > 0))
    return rows.join(norms, key).withColumn("weight", F.col("weight") / F.col("norm")).drop(
        "norm", "active"
    )


def _build_index(entries: pa.Table, terms: pa.Array, idf: np.ndarray, form: str, key: str,
                 min_active: int, partial: bool) -> ItemIndex:
    """Normalise the fetched item weights and sort them by term."""
    items, column = np.unique(entries[key].to_numpy(zero_copy_only=False), return_inverse=True)
    idx, weight = entries["idx"].to_numpy(), entries["weight"].to_numpy()
    active = np.bincount(column, minlength=len(items))
    norms = np.sqrt(np.bincount(column, weights=weight * weight, minlength=len(items)).astype(float))
    usable = (active >= min_active) & (norms > 0)
    keep = usable[column]
    column, idx, weight = column[keep], idx[keep], weight[keep] / norms[column[keep]]
    column = (np.cumsum(usable) - 1)[column].astype(np.int32)
    order = np.lexsort((column, idx))
    starts = np.zeros(len(terms) + 1, dtype=np.int64)
    np.cumsum(np.bincount(idx, minlength=len(terms)), out=starts[1:])
    return ItemIndex(
        items=items[usable], terms=terms, idf=idf, starts=starts,
        columns=column[order], values=weight[order], form=form, partial=partial)


def _batch_weights(batch: pa.RecordBatch, index: ItemIndex):
    """Known terms of a batch: (row, term, weight) in row order."""
    runs = batch.column("runs")
    flat = runs.flatten()
    lengths = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
    rows = np.repeat(np.arange(len(runs)), lengths)
    # Each distinct term of the batch is looked up once.
    coded = flat.field(0).dictionary_encode()
    lookup = pc.fill_null(pc.index_in(coded.dictionary, value_set=index.terms), -1).to_numpy(
        zero_copy_only=False)
    terms = lookup[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, int)
    tf = flat.field(1).to_numpy(zero_copy_only=False).astype(float)
    known = terms >= 0
    rows, terms, tf = rows[known], terms[known], tf[known]
    if index.form == "tfidf":
        weight = tf * index.idf[terms]
    elif index.form == "binary":
        weight = (tf > 0.99).astype(float)
    else:
        weight = tf
    return rows, terms, weight


def _lengths(batch: pa.RecordBatch, index: ItemIndex, rows, weight):
    """Length and number of known terms of each post, carried along where the index lacks terms."""
    if index.partial:
        return (batch.column("norm").fill_null(0.0).to_numpy(zero_copy_only=False),
                batch.column("active").fill_null(0).to_numpy(zero_copy_only=False))
    # bincount over nothing yields ints whatever the weights are
    n = batch.num_rows
    return (np.sqrt(np.bincount(rows, weights=weight * weight, minlength=n).astype(float)),
            np.bincount(rows, minlength=n))


def _score_blocks(n_rows: int, rows, terms, weight, norms, index: ItemIndex):
    """Yield (first row, score matrix) blocks; a block is bounded by SCORE_CELLS or one row."""
    n_items = len(index.items)
    span = index.starts[terms + 1] - index.starts[terms]
    work = np.bincount(rows, weights=span, minlength=n_rows) + n_items
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    block = np.cumsum(work) // SCORE_CELLS
    edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [n_rows]))
    for first, last in zip(edges[:-1], edges[1:]):
        if first == last:
            continue
        lo, hi = bounds[first], bounds[last]
        reps = span[lo:hi]
        begin = index.starts[terms[lo:hi]] - (np.cumsum(reps) - reps)
        posting = np.repeat(begin, reps)
        posting += np.arange(len(posting))
        cell = np.repeat((rows[lo:hi] - first) * n_items, reps)
        cell += index.columns[posting]
        product = np.repeat(weight[lo:hi], reps)
        product *= index.values[posting]
        scores = np.bincount(cell, weights=product, minlength=(last - first) * n_items)
        # a row without length has no term, so its scores are 0 as they stand
        scores = scores.astype(float, copy=False).reshape(last - first, n_items)
        length = norms[first:last, None]
        np.divide(scores, length, out=scores, where=length > 0)
        yield first, np.round(scores, DECIMALS, out=scores)


def _post_batches(posts: DataFrame, key: str, model: TermModel, shipped: Broadcast, partial: bool,
                  n_items: int, carried: tuple[str, ...] = (), threshold: float = 0.0) -> DataFrame:
    """Posts with the counts of their terms, and their lengths where the index has no other terms.

    Work grows with posts times items, which sizes of files do not tell: posts are dealt to as many
    tasks as keep each within TASK_CELLS. Lengths need the frequencies of all terms of a post, so they
    are worked out only for posts that the terms of the index leave a chance.
    """
    posts = _dealt(posts, n_items)
    rows = posts.select(key, *carried, term_runs(F.col("terms")).alias("runs"))
    if not partial:
        return rows

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in run_parts(batches):
            n = batch.num_rows
            at, terms, weight = _batch_weights(batch, index)
            if threshold <= 0:
                yield batch.filter(pa.array(np.bincount(at, minlength=n) > 0))
                continue
            # no longer than this by the terms of the index alone, so no similarity is higher
            least = np.sqrt(np.bincount(at, weights=weight * weight, minlength=n).astype(float))
            keep = np.zeros(n, bool)
            for first, scores in _blocks_if_any(n, at, terms, weight, least, index):
                keep[first:first + len(scores)] = scores.max(axis=1) > threshold - MARGIN
            yield batch.filter(pa.array(keep))

    rows = landed(rows.mapInArrow(possible, rows.schema), "possible-posts")
    runs = rows.select(key, F.inline("runs"))
    lengths = model.restricted(runs).of_runs(runs, rows.count()).groupBy(key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.count(F.lit(1)).alias("active"))
    return rows.join(landed(lengths, "lengths"), key, "left")


def _dealt(posts: DataFrame, n_items: int) -> DataFrame:
    tasks = -(-posts.count() * n_items // TASK_CELLS)
    return posts.repartition(tasks) if tasks > max(1, posts.rdd.getNumPartitions()) else posts


def _shipped_index(items: DataFrame, key: str, model: TermModel, min_active: int,
                   max_entries: int) -> tuple[Broadcast, bool, int] | None:
    """The item side as a shipped index when it is small enough, else None.

    A vocabulary beyond INDEX_TERMS stays where it is: the index then holds the items' terms only,
    and posts bring their lengths along.
    """
    if max_entries <= 0:
        return None
    partial = model.size > INDEX_TERMS
    rows = items.select(key, "terms")
    if partial:
        runs = exploded_runs(rows)
        weights = model.restricted(runs).of_runs(runs, items.count()).select(
            key, "term", "idf", "weight")
    else:
        weights = model.weights(rows).select(key, "idx", "weight")
    # One row more than the bound tells whether the bound holds, whatever the true size.
    entries = weights.limit(max_entries + 1).toArrow()
    if entries.num_rows > max_entries:
        return None
    if partial:
        index = _own_terms_index(entries, model.form, key, min_active)
        return items.sparkSession.sparkContext.broadcast(index), partial, len(index.items)
    order = np.argsort(model.entries["idx"].to_numpy())
    terms = model.entries["term"].take(pa.array(order)).combine_chunks()
    idf = model.entries["idf"].to_numpy()[order]
    index = _build_index(entries, terms, idf, model.form, key, min_active, partial)
    return items.sparkSession.sparkContext.broadcast(index), partial, len(index.items)


def _own_terms_index(entries: pa.Table, form: str, key: str, min_active: int) -> ItemIndex:
    """An index of the terms of (key, term, idf, weight) entries only."""
    coded = entries["term"].combine_chunks().dictionary_encode()
    idx, terms = coded.indices.to_numpy(), coded.dictionary
    idf = np.empty(len(terms))
    idf[idx] = entries["idf"].to_numpy()
    return _build_index(entries.append_column("idx", pa.array(idx)), terms, idf, form, key,
                        min_active, True)


def _own_weights(items: DataFrame, key: str, model: TermModel) -> DataFrame:
    return landed(model.term_weights(items.select(key, "terms")).select(key, "term", "idf", "weight"),
                  "item-weights")


def _scored_by_shard(posts: DataFrame, weights: DataFrame, model: TermModel, item_key: str,
                     min_active: int, max_entries: int, scorer, schema: T.StructType) -> DataFrame:
    """What ``scorer`` makes of the posts for each index of about ``max_entries`` of the item entries.

    ``posts`` have ``runs``, ``norm`` and ``active``; an item lies in one index as a whole.
    """
    context = posts.sparkSession.sparkContext
    shards = max(1, -(-weights.count() // max_entries))
    parts = None
    for shard in range(shards):
        own = weights.where(F.pmod(row_key(F.col(item_key)), F.lit(shards)) == shard)
        index = _own_terms_index(own.toArrow(), model.form, item_key, min_active)
        found = _dealt(posts, len(index.items)).mapInArrow(scorer(context.broadcast(index)), schema)
        parts = found if parts is None else parts.unionByName(found)
    return parts


def best_items(posts: DataFrame, items: DataFrame, model: TermModel, *, post_key: str = "post_id",
               item_key: str = "item_id", threshold: float = 0.0, min_active: int = 0,
               max_entries: int = INDEX_ENTRIES) -> DataFrame:
    """(post, item, similarity): each post's best item when it is strictly above ``threshold``.

    Ties go to the smallest item id. Posts and items with fewer than ``min_active`` known
    terms take no part.
    """
    shipped = _shipped_index(items, item_key, model, min_active, max_entries)
    best = most_similar(item_key)
    if shipped is None and (threshold > 0 or max_entries <= 0):
        weights = item_weights(items, item_key, model, min_active)
        pairs = _joined_pairs(posts, weights, model, post_key, item_key, min_active, threshold)
        return pairs.groupBy(post_key).agg(best.alias("best")).select(post_key, "best.*")
    kept = [post_key] if shipped is not None else ["__row", post_key]
    schema = T.StructType([
        *[T.StructField("__row", T.LongType())][len(kept) == 1:], posts.schema[post_key],
        items.schema[item_key], T.StructField("similarity", T.DoubleType()),
    ])
    item_type = _arrow_type(items, item_key)

    def scorer(broadcast: Broadcast):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = broadcast.value
            for batch in run_parts(batches):
                rows, terms, weight = _batch_weights(batch, index)
                norms, active = _lengths(batch, index, rows, weight)
                at, item, value = [], [], []
                for first, scores in _blocks_if_any(
                        batch.num_rows, rows, terms, weight, norms, index):
                    best = scores.argmax(axis=1)  # the first maximum is the smallest item id
                    top = scores[np.arange(len(scores)), best]
                    hit = np.flatnonzero((top > threshold) & (top > 0)
                                         & (active[first:first + len(scores)] >= min_active))
                    at.append(first + hit)
                    item.append(index.items[best[hit]])
                    value.append(top[hit])
                if at:
                    picked = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(pa.array(picked)) for c in kept],
                         pa.array(np.concatenate(item), type=item_type),
                         pa.array(np.concatenate(value))],
                        names=[*kept, item_key, "similarity"],
                    )

        return score

    if shipped is not None:
        shipped, partial, n_items = shipped
        return _post_batches(posts, post_key, model, shipped, partial, n_items,
                             threshold=threshold).mapInArrow(scorer(shipped), schema)
    rows = _numbered_runs(posts, post_key)
    lengths = model.of_runs(rows.select("__row", F.inline("runs")), rows.count()).groupBy("__row").agg(
        _norm().alias("norm"), F.count(F.lit(1)).alias("active"))
    rows = landed(rows.join(lengths, "__row"), "weighed-posts")
    found = _scored_by_shard(rows, _own_weights(items, item_key, model), model, item_key, min_active,
                             max_entries, scorer, schema)
    return found.groupBy("__row", post_key).agg(best.alias("best")).select(post_key, "best.*")


def _numbered_runs(posts: DataFrame, *columns: str) -> DataFrame:
    """Posts with the counts of their terms and a number of their own, since ids may repeat."""
    return landed(posts.select(F.monotonically_increasing_id().alias("__row"), *columns, term_runs(
        F.col("terms")).alias("runs")), "post-runs")


def _norm() -> Column:
    return F.sqrt(F.sum(F.col("weight") * F.col("weight")))


def _blocks_if_any(n_rows, rows, terms, weight, norms, index):
    return _score_blocks(n_rows, rows, terms, weight, norms, index) if len(index.items) else ()


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def most_similar(key: str) -> Column:
    """Aggregate (key, similarity): the highest similarity, ties to the smallest key of any type.

    It combines on the map side, so a group of any size is no hot task.
    """
    return F.min_by(F.struct(key, "similarity"), F.struct(-F.col("similarity"), key))


def similar_items(posts: DataFrame, items: DataFrame, model: TermModel, *,
                  post_key: str = "post_id", item_key: str = "item_id", threshold: float = 0.0,
                  min_active: int = 0, max_entries: int = INDEX_ENTRIES) -> DataFrame:
    """(post, matches): every item strictly above ``threshold``, grouped by post.

    Pairs that share no term have similarity 0 and are left out. ``matches`` is
    ``array<struct<item, similarity>>`` in item order.
    """
    shipped = _shipped_index(items, item_key, model, min_active, max_entries)
    entry = T.StructType([items.schema[item_key], T.StructField("similarity", T.DoubleType())])
    if shipped is None:
        weights = item_weights(items, item_key, model, min_active)
        pairs = _joined_pairs(posts, weights, model, post_key, item_key, min_active, threshold)
        return pairs.groupBy(post_key).agg(
            F.sort_array(F.collect_list(F.struct(item_key, "similarity"))).alias("matches")
        )
    shipped, partial, n_items = shipped
    schema = T.StructType([posts.schema[post_key], T.StructField("matches", T.ArrayType(entry))])
    item_type = _arrow_type(items, item_key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in run_parts(batches):
            rows, terms, weight = _batch_weights(batch, index)
            norms, active = _lengths(batch, index, rows, weight)
            for first, scores in _blocks_if_any(
                    batch.num_rows, rows, terms, weight, norms, index):
                scores[active[first:first + len(scores)] < min_active] = 0.0
                row, column = np.nonzero((scores > threshold) & (scores > 0))
                counts = np.bincount(row, minlength=len(scores))
                hit = np.flatnonzero(counts)
                offsets = np.concatenate(([0], np.cumsum(counts[hit]))).astype(np.int32)
                matches = pa.StructArray.from_arrays(
                    [pa.array(index.items[column], type=item_type), pa.array(scores[row, column])],
                    names=[item_key, "similarity"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(post_key).take(pa.array(first + hit)),
                     pa.ListArray.from_arrays(pa.array(offsets), matches)],
                    names=[post_key, "matches"],
                )

    return _post_batches(posts, post_key, model, shipped, partial, n_items,
                         threshold=threshold).mapInArrow(score, schema)


def true_item_ranks(posts: DataFrame, items: DataFrame, model: TermModel, *,
                    post_key: str = "post_id", item_key: str = "item_id",
                    true_key: str = "true_item_id", max_entries: int = INDEX_ENTRIES) -> DataFrame:
    """(post, true item, best item, rank, confidence) for posts with a known true item.

    ``rank`` is the number of items strictly more similar than the true one (0 is right),
    ``confidence`` the best similarity. Posts whose true item is not in ``items`` drop out.
    """
    shipped = _shipped_index(items, item_key, model, 0, max_entries)
    columns = [post_key, true_key, item_key, "rank", "confidence"]
    if shipped is None and max_entries > 0:
        return _ranks_by_shard(posts, items, model, post_key, item_key, true_key, max_entries)
    if shipped is None:
        weights = item_weights(items, item_key, model)
        pairs = _joined_pairs(posts, weights, model, post_key, item_key, 0)
        known = posts.select(post_key, true_key).join(
            weights.select(F.col(item_key).alias(true_key)).distinct(), true_key, "left_semi")
        scored = known.join(pairs, post_key)
        truth = F.max(F.when(F.col(item_key) == F.col(true_key), F.col("similarity")))
        best = most_similar(item_key)
        # Two aggregates over the same grouping; no window collects a post's pairs.
        per_post = scored.groupBy(post_key, true_key).agg(
            F.coalesce(truth, F.lit(0.0)).alias("true_similarity"), best.alias("best"))
        above = scored.join(per_post, [post_key, true_key]).groupBy(post_key, true_key).agg(
            F.count_if(F.col("similarity") > F.col("true_similarity")).alias("rank"),
            F.first("best").alias("best"))
        return above.select(
            post_key, true_key, f"best.{item_key}", F.col("rank").cast("int").alias("rank"),
            F.col("best.similarity").alias("confidence"))
    shipped, partial, n_items = shipped
    schema = T.StructType([
        posts.schema[post_key], posts.schema[true_key], items.schema[item_key],
        T.StructField("rank", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
    ])
    item_type = _arrow_type(items, item_key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in run_parts(batches):
            rows, terms, weight = _batch_weights(batch, index)
            norms, _ = _lengths(batch, index, rows, weight)
            truth = batch.column(true_key).to_numpy(zero_copy_only=False)
            for first, scores in _blocks_if_any(
                    batch.num_rows, rows, terms, weight, norms, index):
                wanted = truth[first:first + len(scores)]
                column = np.minimum(np.searchsorted(index.items, wanted), len(index.items) - 1)
                best = scores.argmax(axis=1)
                line = np.arange(len(scores))
                top = scores[line, best]
                hit = np.flatnonzero((index.items[column] == wanted) & (top > 0))
                rank = np.count_nonzero(scores > scores[line, column][:, None], axis=1)[hit]
                taken = pa.array(first + hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(post_key).take(taken), batch.column(true_key).take(taken),
                     pa.array(index.items[best[hit]], type=item_type),
                     pa.array(rank.astype(np.int32)), pa.array(top[hit])],
                    names=columns,
                )

    return _post_batches(posts, post_key, model, shipped, partial, n_items, (true_key,)).mapInArrow(
        score, schema)


def _ranks_by_shard(posts: DataFrame, items: DataFrame, model: TermModel, post_key: str,
                    item_key: str, true_key: str, max_entries: int) -> DataFrame:
    """true_item_ranks for item sides too large for one index, whose counts of better items add up.

    A post brings along the similarity of its true item, so it is known wherever the post is scored.
    """
    weights = _own_weights(items, item_key, model)
    norms = weights.groupBy(item_key).agg(_norm().alias("item_norm")).where("item_norm > 0")
    unit = landed(weights.join(norms, item_key).groupBy(
        F.struct(F.col(item_key).alias("item"), "term").alias("own")).agg(
        F.sum(F.col("weight") / F.col("item_norm")).alias("item_weight")), "unit-weights")
    truth = F.col(true_key).cast(items.schema[item_key].dataType)
    known = lookup_join(posts, unit.select(F.col("own.item").alias("known_item")).distinct().select(
        F.col("known_item").cast(posts.schema[true_key].dataType).alias(true_key)), true_key, "left_semi")
    rows = _numbered_runs(known, post_key, true_key)
    own = lookup_join(model.of_runs(rows.select("__row", true_key, F.inline("runs")), rows.count())
                      .withColumn("own", F.struct(truth.alias("item"), "term")), unit, "own", "left",
                      written=True, unique=True, most_left=rows.count())
    lengths = own.groupBy("__row").agg(
        _norm().alias("norm"), F.count(F.lit(1)).alias("active"),
        F.coalesce(F.sum(F.col("weight") * F.col("item_weight")), F.lit(0.0)).alias("dot"))
    held = F.round(F.coalesce(F.try_divide("dot", "norm"), F.lit(0.0)), DECIMALS)
    rows = landed(rows.join(lengths.withColumn("held", held).drop("dot"), "__row"), "weighed-posts")
    kept = ["__row", post_key, true_key]
    schema = T.StructType([
        T.StructField("__row", T.LongType()), posts.schema[post_key], posts.schema[true_key],
        items.schema[item_key], T.StructField("similarity", T.DoubleType()),
        T.StructField("above", T.LongType())])
    item_type = _arrow_type(items, item_key)

    def scorer(broadcast: Broadcast):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = broadcast.value
            for batch in run_parts(batches):
                at, terms, weight = _batch_weights(batch, index)
                norms, _ = _lengths(batch, index, at, weight)
                held = batch.column("held").to_numpy(zero_copy_only=False)
                for first, scores in _blocks_if_any(batch.num_rows, at, terms, weight, norms, index):
                    best = scores.argmax(axis=1)
                    top = scores[np.arange(len(scores)), best]
                    hit = np.flatnonzero(top > 0)
                    above = np.count_nonzero(
                        scores > (held[first:first + len(scores)] + APART)[:, None], axis=1)
                    taken = pa.array(first + hit)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(taken) for c in kept],
                         pa.array(index.items[best[hit]], type=item_type), pa.array(top[hit]),
                         pa.array(above[hit])], names=schema.names)

        return score

    found = _scored_by_shard(rows, weights, model, item_key, 0, max_entries, scorer, schema)
    return found.groupBy(*kept).agg(
        F.sum("above").cast("int").alias("rank"), most_similar(item_key).alias("best")).select(
        post_key, true_key, f"best.{item_key}", "rank", F.col("best.similarity").alias("confidence"))


def _joined_pairs(posts: DataFrame, item_rows: DataFrame, model: TermModel, post_key: str,
                  item_key: str, min_active: int, threshold: float = 0.0) -> DataFrame:
    """(post, item, similarity) above ``threshold``, for item sides too large to ship.

    Vectors have unit length, so the most frequent terms of an item whose weights together
    measure at most ``threshold`` cannot lift a pair above it on their own. Only the other,
    rarer terms of an item are joined; a pair whose sum over them plus the length of the
    left-out part stays below the threshold is dropped, and only the remaining pairs get
    their missing products. With threshold 0 no term can be left out.
    """
    known = model.weights(posts.select(post_key, "terms")).select(
        post_key, "idx", "doc_freq", "weight")
    post_rows = landed(known, "post-weights")  # read three times below
    norms = post_rows.groupBy(post_key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.count(F.lit(1)).alias("active"),
    ).where((F.col("active") >= min_active) & (F.col("norm") > 0)).drop("active")
    # An item's terms from the most frequent on, with the length of all up to each of them.
    hottest = W.partitionBy(item_key).orderBy(F.desc("doc_freq"), "idx").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    measured = item_rows.select(item_key, "idx", "doc_freq", F.col("weight").alias("item_weight"))
    measured = measured.withColumn("length", F.sqrt(
        F.sum(F.col("item_weight") * F.col("item_weight")).over(hottest)))
    split = landed(measured.withColumn(
        "rare", F.col("length") > F.lit(max(threshold - MARGIN, 0.0))), "item-weights")
    rare, frequent = split.where("rare"), split.where(~F.col("rare"))

    salts = F.greatest(F.lit(1), F.ceil(F.col("doc_freq") / ROWS_PER_SALT)).cast("int")
    left = post_rows.withColumn("salt", F.pmod(row_key(F.col(post_key)), salts).cast("int"))
    copies = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    products = left.drop("doc_freq").join(copies.drop("doc_freq"), ["idx", "salt"])
    partial = products.groupBy(post_key, item_key).agg(
        F.sum(F.col("weight") * F.col("item_weight")).alias("dot")).join(norms, post_key)
    if threshold > 0:
        rest = frequent.groupBy(item_key).agg(
            F.max("length").alias("rest"),
            F.collect_list(F.struct("idx", "item_weight")).alias("entries"))
        open_pairs = lookup_join(partial, rest, item_key, "left")
        reach = F.col("dot") / F.col("norm") + F.coalesce("rest", F.lit(0.0))
        open_pairs = landed(open_pairs.where(reach > threshold - MARGIN), "pairs")
        missing = open_pairs.select(post_key, item_key, F.inline("entries")).join(
            post_rows.drop("doc_freq"), [post_key, "idx"])
        added = missing.groupBy(post_key, item_key).agg(
            F.sum(F.col("weight") * F.col("item_weight")).alias("added"))
        partial = open_pairs.join(added, [post_key, item_key], "left").withColumn(
            "dot", F.col("dot") + F.coalesce("added", F.lit(0.0)))
    similarity = F.round(F.col("dot") / F.col("norm"), DECIMALS)
    return partial.select(post_key, item_key, similarity.alias("similarity")).where(
        (F.col("similarity") > 0) & (F.col("similarity") > threshold))


def best_post_per_item(links: DataFrame, post_key: str = "post_id",
                       item_key: str = "item_id") -> DataFrame:
    """One-to-one links: the most similar post of each item, ties to the smallest post id."""
    return links.groupBy(item_key).agg(most_similar(post_key).alias("best")).select(
        item_key, "best.*")


def posts_per_item(links: DataFrame, post_key: str = "post_id", item_key: str = "item_id",
                   posts_per_row: int = 100_000) -> DataFrame:
    """(item, part, posts): all linked posts of each item.

    An item may hold any number of posts, so its list is cut into parts of about
    ``posts_per_row``; an item with fewer links has the single part 0.
    """
    sizes = links.groupBy(item_key).agg(
        F.ceil(F.count(F.lit(1)) / posts_per_row).alias("parts"))
    parted = lookup_join(links, sizes, item_key).withColumn(
        "part", F.pmod(row_key(F.col(post_key)), F.col("parts")).cast("int"))
    return parted.groupBy(item_key, "part").agg(
        F.sort_array(F.collect_list(F.struct(post_key, "similarity"))).alias("posts"))


def first_posts_per_item(links: DataFrame, cap: int = 2, post_key: str = "post_id",
                         item_key: str = "item_id") -> DataFrame:
    """The first ``cap`` posts of each item by id.

    A cap inside the window is a group limit, which Spark applies before the shuffle too.
    """
    order = F.row_number().over(W.partitionBy(item_key).orderBy(post_key))
    return links.withColumn("n", order).where(F.col("n") <= cap).drop("n")
