"""Similarity join on word shingles: MinHash LSH forest, then exact verification.

Every distinct shingle set gets TREES labels, each a string of DEPTH MinHash values. Sorted, the
labels of a tree are a prefix trie: sets that agree on a prefix stand together. Matching starts from
whole labels. The pairs met there are measured by the share of equal values in all trees; as long as
some pair that may be at the threshold would be met with less than the target probability, prefixes
are shortened by a value and matched again. The shortest length that can be needed, that of a pair
right at the threshold, is known beforehand, so leaves without a neighbour there are left out of all
levels. Sets under a common prefix are linked to its least member only, never pair by pair; the
components of these links hold all candidate pairs.

Shingles then travel once, to their component, and all pairs of a component are verified
exactly in matrices of shared shingles. A large component is dealt over several blocks by hash and
each pair of blocks is a group of its own, so that groups stay bounded; only counts and one
spanning link a set leave a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.components import components
from catalink.llm.hashing import mix, word_hashes
from catalink.llm.textbytes import unused
from catalink.session import landed

WORDS, THRESHOLD = 5, 0.8
#: Trees, MinHash values of a label, bits of a value, and the recall prefixes are shortened for.
TREES, DEPTH, VALUE_BITS, RECALL = 16, 6, 10, 0.999
#: Standard errors by which a measured similarity may be too high or too low.
ERRORS = 3
#: Bounds of a block of a component: sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 19
#: Shingles signed, and columns of a matrix of shared shingles, at a time.
SIGNED, COLUMNS = 1 << 14, 1 << 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of runs of five words; fewer words, but not none, are one shingle."""
    if not text:
        return np.zeros(0, np.uint64)
    _, words = word_hashes(text.encode().translate(_LOWER.tobytes()), _BLANK)
    if not len(words):
        return words
    n = min(len(words), WORDS)
    run = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        run = (run + words[k:k + len(run)]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(run))


def recall_at(depth: int, similarity: float) -> float:
    """Probability that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity ** depth) ** TREES


def shortest_prefix(threshold: float) -> int:
    """Length at which a pair right at the threshold is met with the wanted probability."""
    return next((d for d in range(DEPTH, 1, -1) if recall_at(d, threshold) >= RECALL), 1)


def long_enough(depth: int, threshold: float, equal: list[int]) -> bool:
    """Whether prefixes of this length meet the recall for pairs with so many equal values.

    A pair may be up to ERRORS standard errors less similar than measured; pairs that are
    below the threshold even with as much added do not count.
    """
    values = TREES * DEPTH
    for n in equal:
        error = ERRORS * (max(n * (values - n), values) / values) ** 0.5
        if n + error >= threshold * values and (
                recall_at(depth, max(threshold, (n - error) / values)) < RECALL):
            return False
    return True


def labels(found: np.ndarray) -> np.ndarray:
    """For each tree, the label of DEPTH MinHash values as one number, the first value highest."""
    factors = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), SIGNED):
        least = np.minimum(least, (factors[:, None] * found[a:a + SIGNED]).min(axis=1))
    values = (mix(least) >> np.uint64(64 - VALUE_BITS)).reshape(TREES, DEPTH)
    out = np.zeros(TREES, np.uint64)
    for k in range(DEPTH):
        out = out << np.uint64(VALUE_BITS) | values[:, k]
    return out.astype(np.int64)


def node_of(found: np.ndarray) -> bytes | None:
    """128 bits that name a shingle set; none for the empty set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, node, n_shingles, labels of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([
                batch.column(0), batch.column(2),
                pa.array([node_of(x) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([labels(x) if len(x) else [] for x in sets],
                         pa.list_(pa.int64()))],
                ["doc_id", "digest", "node", "n_shingles", "labels"])

    return docs.select("doc_id", "text", "digest").mapInArrow(
        sign, f"doc_id {kind}, digest binary, node binary, n_shingles long, labels array<long>")


def _prefix(depth: int) -> Column:
    return F.shiftright("label", VALUE_BITS * (DEPTH - depth))


def _equal_values(left: str, right: str) -> Column:
    """In how many values two sets' labels agree, of TREES * DEPTH."""
    def of_tree(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        return sum(((F.shiftright(differ, VALUE_BITS * k) % (1 << VALUE_BITS)) == 0).cast("int")
                   for k in range(DEPTH))

    return F.aggregate(F.zip_with(left, right, of_tree), F.lit(0), lambda total, n: total + n)


def candidate_links(sets: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Links from each set to the least set that shares a prefix with it, and the prefix length.

    The least sets of a level are written first, with their labels, so Spark can split the join
    of a prefix that many share.
    """
    shortest = shortest_prefix(threshold)
    leaves = sets.select("node", F.posexplode("labels").alias("tree", "label"))
    near = leaves.withColumn("prefix", _prefix(shortest))
    several = landed(near.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").drop("n"), "prefixes")
    leaves = landed(near.join(several, ["tree", "prefix"], "left_semi").drop("prefix"), "leaves")
    for depth in range(DEPTH, shortest - 1, -1):
        rows = leaves.withColumn("prefix", _prefix(depth))
        least = (rows.groupBy("tree", "prefix")
                 .agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .join(sets.select(F.col("node").alias("least"), F.col("labels").alias("theirs")),
                       "least").drop("n"))
        links = (rows.join(landed(least, "least"), ["tree", "prefix"]).filter("node != least")
                 .select("node", "least", "theirs"))
        if depth > shortest:
            links = landed(links.join(sets.select("node", "labels"), "node").select(
                "node", "least", _equal_values("labels", "theirs").alias("equal")), "links")
            equal = [r.equal for r in links.groupBy("equal").count().collect()]
            if not long_enough(depth, threshold, equal):
                continue
        break
    return links.select(F.col("node").alias("a"), F.col("least").alias("b")), depth


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets reach the threshold with which, from counts of shared shingles."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[low:high], column[low:high] - a] = 1
        part = part[:, :int(column[high - 1]) - a + 1]
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    root = np.arange(len(linked))
    while True:
        around = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        after = np.minimum(root, around)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """node, links (documents of other sets), hub: a spanning link; from rows of bounded groups.

    members: group, i, j, comp, own (block of the set), node, copies, shingles.
    """
    schema = pa.schema([("comp", pa.binary()), ("split", pa.bool_()), ("node", pa.binary()),
                        ("links", pa.int64()), ("hub", pa.binary())])

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("node", "ascending")])
        rows = table.select(["comp", "own", "i", "j", "node", "copies", "split"]).to_pandas()
        found = table.column("shingles").to_pylist()
        out = []
        for comp, part in rows.groupby("comp", sort=False):
            part = part[~part["node"].duplicated()]  # rows that repeat an id and its text
            sets = [np.frombuffer(found[k], np.uint64) for k in part.index]
            linked = similar(sets, threshold)
            own = part["own"].to_numpy()
            if part["i"].iloc[0] != part["j"].iloc[0]:
                linked &= own[:, None] != own[None, :]
            links = linked @ part["copies"].to_numpy()
            hub = part["node"].to_numpy()[roots(linked)]
            out.append(pd.DataFrame({"comp": comp, "split": part["split"], "node": part["node"],
                                     "links": links.astype(np.int64), "hub": hub}))
        return pa.Table.from_pandas(pd.concat(out), schema, preserve_index=False)

    return members.groupBy("group", "i", "j").applyInArrow(
        verify, "comp binary, split boolean, node binary, links long, hub binary")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, set_id.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is
    `threshold` or more. class_id: largest id among the documents connected by links; n_links:
    other documents linked with this one, copies included; set_id: largest id of the documents
    with the same set. Null, empty and wordless texts have no shingles: no links, their own id in
    both columns. Rows that repeat count as copies. Null ids come last. Other columns of `docs`
    are ignored; an empty table gives an empty result.
    """
    return _joined(docs, id_col, text_col, threshold, F.lit(None).cast("binary")).select(
        "doc_id", "class_id", "n_links", "set_id")


def _joined(docs: DataFrame, id_col: str, text_col: str, threshold: float,
            digest: Column) -> DataFrame:
    """The rows of the join with digest (as given) and root (name of the class, null if wordless)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"),
                       digest.alias("digest"))
    known = landed(signed(rows), "signatures")
    classes = landed(
        known.filter("node is not null").groupBy("node").agg(
            F.max("doc_id").alias("set_id"), F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")),
        "classes")
    near = components(candidate_links(classes, threshold)[0])
    near = landed(near.withColumnRenamed("root", "comp").join(classes.drop("labels"), "node"),
                  "candidates")
    found = landed(verified(_members(rows, near), threshold), "verified")
    # a component in one block has its groups already; the others are joined block by block
    spread = components(found.filter("split").select(F.col("node").alias("a"),
                                                     F.col("hub").alias("b")))
    whole = found.filter("not split").select("node", F.col("hub").alias("root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = landed(classes.select("node", "set_id", "copies")
                   .join(whole.unionByName(spread), "node", "left").join(links, "node", "left")
                   .withColumn("root", F.coalesce("root", "node")), "groups")
    largest = landed(group.groupBy("root").agg(F.max("set_id").alias("class_id")), "largest")
    sets = landed(group.join(largest, "root").select(
        "node", "root", "set_id", "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "sets")
    return known.select("doc_id", "digest", "node").join(sets, "node", "left").select(
        "doc_id", "digest", "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"))


def _members(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Candidates with their shingles, dealt to groups of bounded size."""
    size = (near.groupBy("comp").agg(F.sum("n_shingles").alias("all"), F.count(F.lit(1)).alias("n"))
            .select("comp", F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES),
                                       F.ceil(F.col("n") / BLOCK_SETS)).cast("int").alias("blocks")))
    total = near.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    bundles = 1 + max((total[0] or 0) // BLOCK_SHINGLES, total[1] // BLOCK_SETS)
    dealt = (near.join(size, "comp")
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .select(F.col("set_id").alias("doc_id"), "comp", "node", "copies", "blocks", "own"))

    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            # rows of the same id may hold other texts
            right = pa.array([node_of(x) == n.as_py()
                              for x, n in zip(sets, batch.column("node"))], pa.bool_())
            out = batch.drop_columns(["text"]).append_column(
                "shingles", pa.array([x.tobytes() for x in sets], pa.binary()))
            yield out.filter(right)

    text = (rows.join(dealt.withColumnRenamed("doc_id", "__id"),
                      F.col("doc_id").eqNullSafe(F.col("__id")))
            .select("doc_id", "comp", "node", "copies", "blocks", "own", "text")
            .mapInArrow(read, f"doc_id {kind}, comp binary, node binary, copies long, blocks int, "
                              "own int, shingles binary"))
    split = F.col("blocks") > 1
    return (text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.when(split, F.xxhash64("comp"))
                    .otherwise(F.pmod(F.xxhash64("comp"), F.lit(bundles))).alias("group"),
                    F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    split.alias("split"), "comp", "own", "node", "copies", "shingles"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the largest id, and all wordless rows; all columns kept.

    Rows are told apart by id and text, so a class whose ids are all null, or whose largest id
    belongs to several of its texts, keeps the text of the least digest; rows equal in both are
    one.
    """
    own, key = unused("kept_id", docs), unused("kept_digest", docs)
    digest = F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")))
    joined = landed(_joined(docs, id_col, text_col, THRESHOLD, digest)
                    .filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
                    .select("doc_id", "digest", "root"), "largest")
    one = (joined.filter("root is not null").groupBy("root")
           .agg(F.min(F.struct("digest", "doc_id")).alias("least"), F.count(F.lit(1)).alias("n"))
           .select("least.doc_id", "least.digest", (F.col("n") > 1).alias("several")))
    wordless = joined.filter("root is null").select("doc_id", "digest").distinct()
    stays = landed(one.unionByName(wordless.withColumn("several", F.lit(False))).select(
        F.col("doc_id").alias(own), F.col("digest").alias(key), "several"), "stays")

    def rows_of(stays: DataFrame) -> DataFrame:
        return docs.join(stays.drop("several"), F.col(f"`{id_col}`").eqNullSafe(F.col(own))
                         & digest.eqNullSafe(F.col(key)), "left_semi")

    kept = rows_of(stays.filter("not several"))
    again = stays.filter("several")
    return kept if again.isEmpty() else kept.unionByName(
        rows_of(again).dropDuplicates([id_col, text_col]))
