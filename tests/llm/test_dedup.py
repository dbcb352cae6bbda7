"""Exact copies, repeated strings and similar shingles against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.llm import components, exact_dedup, jaccard_join, substrings

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def last(ids):
    return max((i for i in ids if i is not None), default=None)


def test_exact_copies(messy):
    rows, docs = messy
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter((i, last(groups[t or ""]), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    got = exact_dedup.exact_copies(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_rare_and_frequent_digests_give_one_result(messy, monkeypatch):
    _, docs = messy
    want = sorted(map(str, exact_dedup.exact_copies(docs).collect()))
    monkeypatch.setattr(exact_dedup, "REPORTED", 1)
    monkeypatch.setattr(exact_dedup, "TRACKED", 16)
    assert sorted(map(str, exact_dedup.exact_copies(docs).collect())) == want


def test_without_copies_keeps_one_whole_row_of_each_text(messy):
    rows, docs = messy
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert Counter(r.text or "" for r in got) == Counter({t or "" for _, t, _ in rows})


def test_a_third_of_all_rows_in_one_group(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_copies(docs).filter("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {2997}
    assert sum(r.kept for r in got) == 1


def removed(texts, window=200):
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                mark[i] += 1
                mark[i + window] -= 1
        yield (np.cumsum(mark)[:-1] > 0).astype(int)


def test_repeated_strings(messy):
    rows, docs = messy
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter()
    for (i, _, _), t, cut in zip(rows, texts, removed(texts)):
        spans = int((np.diff(np.concatenate([[0], cut])) > 0).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[cut == 0])
        want[i, len(t), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = substrings.summary(substrings.remove_repeats(docs)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_repeats_over_many_blocks(messy, monkeypatch):
    """Small blocks and ranges: every answer crosses a border."""
    from catalink.llm import blocks

    rows, docs = messy
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(blocks, "RANGE_BYTES", 4000)
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter((i, int(cut.sum())) for (i, _, _), cut in zip(rows, removed(texts)))
    got = substrings.summary(substrings.remove_repeats(docs)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == want


def test_every_pair_of_positions_reaches_the_cover():
    steps = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert steps == set(range(substrings.PERIOD))


def shingle_set(text):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    n = min(len(w), 5)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else None


def similarity_truth(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    classes, groups = defaultdict(list), defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if sets[k] is not None:
            classes[sets[k]].append(i)
            groups[find(k)].append(i)
    return [(i, last(groups[find(k)]), links[k], last(classes[sets[k]])) if sets[k] is not None
            else (i, i, 0, i) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("block_sets", [256, 2])
def test_similar_documents(messy, monkeypatch, block_sets):
    rows, docs = messy
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block_sets)
    got = jaccard_join.similarity_join(docs).collect()
    assert Counter(map(tuple, got)) == Counter(similarity_truth(rows))


def test_a_chain_of_near_copies_is_one_group(spark, monkeypatch):
    """Neighbours are similar, the ends are not; blocks of a few sets split the component."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    texts = [" ".join(f"w{k}" for k in range(i * 4, i * 4 + 60)) for i in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = jaccard_join.similarity_join(docs).collect()
    assert Counter(map(tuple, got)) == Counter(similarity_truth(rows))
    assert {r.class_id for r in got} == {29}
    assert [r.doc_id for r in jaccard_join.one_of_each_group(docs).collect()] == [29]


def test_one_row_of_each_group_where_ids_are_null_or_repeat(spark):
    near = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcd"]
    rows = [(None, near[0]), (7, near[0] + " end"),          # a class with an id: 7 stays
            (None, near[1]), (None, near[1] + " end"),       # a class of null ids: one stays
            (9, near[2]), (9, near[3]), (11, near[3] + " end"),  # 9 is largest of one class only
            (5, "x " * 80 + near[0][::-1]), (5, "x " * 80 + near[0][::-1]),  # equal rows are one
            (None, "lonely words here"), (None, None), (None, "!!"), (3, ""), (3, "one")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, digest int")
    got = jaccard_join.one_of_each_group(docs)
    assert got.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in got.collect())
    of_nulls = [found.pop((None, t), 0) for t in (near[1], near[1] + " end")]
    assert sorted(of_nulls) == [0, 1]
    assert found == Counter([rows[1], rows[4], rows[6], rows[7], *rows[9:]])


def test_prefixes_shorten_until_the_recall_is_met():
    shortest = jaccard_join.shortest_prefix(0.8)
    assert jaccard_join.recall_at(shortest, 0.8) >= 0.999 > jaccard_join.recall_at(shortest + 1, 0.8)
    values = jaccard_join.TREES * jaccard_join.DEPTH
    assert jaccard_join.long_enough(6, 0.8, [])
    assert jaccard_join.long_enough(6, 0.8, [values // 2, values])  # far below, and copies
    assert not jaccard_join.long_enough(6, 0.8, [int(values * 0.8)])
    assert jaccard_join.long_enough(shortest, 0.8, list(range(values + 1)))


def _edited(rng, n, changed):
    """n texts of 100 words and of each a second one with some words changed, far apart."""
    out = []
    for i in range(n):
        words = [f"t{i}w{k}" for k in range(100)]
        out.append(" ".join(words))
        for k in changed:
            words[k] = f"t{i}new{rng.integers(1 << 30)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("changed, depths", [((99,), {6, 5}), ((50, 70), {4})])
def test_runs_shorten_prefixes_as_the_corpus_needs(spark, changed, depths):
    """Pairs of similarity 0.98 are met by long prefixes; of 0.81, only by the shortest."""
    texts = _edited(np.random.default_rng(5), 60, changed)
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = jaccard_join.signed(docs.withColumn("digest", F.lit(None).cast("binary")))
    links, depth = jaccard_join.candidate_links(known.dropDuplicates(["node"]), 0.8)
    assert depth in depths
    assert links.distinct().count() >= 60
    got = jaccard_join.similarity_join(docs).collect()
    assert Counter(map(tuple, got)) == Counter(similarity_truth(rows))


def test_texts_from_one_template_make_no_large_component(spark):
    """Texts that share a third of their shingles, none of them near another."""
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"t{i}w{k}" for k in range(65)]) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = jaccard_join.signed(docs.withColumn("digest", F.lit(None).cast("binary")))
    links, depth = jaccard_join.candidate_links(known, 0.8)
    sizes = [r["count"] for r in components.components(links).groupBy("root").count().collect()]
    assert depth == 6 and sum(n * (n - 1) // 2 for n in sizes) < 0.01 * 600 * 599 / 2
    assert {r.n_links for r in jaccard_join.similarity_join(docs).collect()} == {0}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == 41 + 200
    assert {(r.node < 100, r.root) for r in got} == {(True, 0), (False, 100)}


def test_empty_tables(empty):
    assert exact_dedup.exact_copies(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert jaccard_join.similarity_join(empty).count() == 0


def _crowded(docs):
    """The same rows with columns that have the operators' helper names, and a dotted id."""
    for name in ("__id", "__digest", "__label", "kept_id", "kept_digest", "KEPT_ID_1", "label_id",
                 "label_value", "digest", "row", "keep"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit("x"))
    return docs.withColumn("the.id", F.col("doc_id"))


def test_clashing_and_dotted_names(messy):
    from catalink.llm import quality

    _, docs = messy
    crowded = _crowded(docs)
    plain = Counter(map(tuple, exact_dedup.exact_copies(docs).collect()))
    assert Counter(map(tuple, exact_dedup.exact_copies(crowded, "the.id").collect())) == plain
    for function in (exact_dedup.without_copies, jaccard_join.one_of_each_group):
        want = Counter((r.doc_id, r.text) for r in function(docs).collect())
        got = function(crowded)
        assert got.columns == crowded.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    labels = docs.where("doc_id < 40").select(
        "doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit("x").alias("__id"))
    assert quality.score_quality(crowded, labels).count() == docs.count()


def test_a_frequent_text_whose_ids_are_null_keeps_one_row(spark):
    docs = spark.range(0, 5000, 1, 6).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("all the same").alias("text"))
    rows = exact_dedup.exact_copies(docs).collect()
    assert sum(r.kept for r in rows) == 1 and {(r.keep_id, r.group_size) for r in rows} == {(None, 5000)}
