import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.operators import factor, link
from catalink.operators.vectorize import (
    fit_terms, number_rows, numbered_keys, packed, ranked_terms, term_statistics,
)
from catalink.plans.tables import term_corpus
from catalink.session import CLEANUP_CONF, dropped, landed

VOCABULARY = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    # One word sits in more than a third of all texts.
    def texts(n):
        return [["w0"] * int(rng.random() < 0.5) + list(rng.choice(VOCABULARY, rng.integers(0, 8)))
                for _ in range(n)]
    post_rows = [(i, i % 9, [str(t) for t in ts]) for i, ts in enumerate(texts(200))]
    item_rows = [(i, [str(t) for t in ts]) for i, ts in enumerate(texts(12))]
    posts = spark.createDataFrame(post_rows, "post_id long, true_item_id long, terms array<string>")
    items = spark.createDataFrame(item_rows, "item_id long, terms array<string>")
    model = fit_terms(posts.select("terms").unionAll(items.select("terms")))
    return post_rows, item_rows, posts.repartition(5), items, model


def brute(post_rows, item_rows):
    docs = [t for *_, t in post_rows] + [t for *_, t in item_rows]
    df = {w: sum(w in d for d in docs) for w in VOCABULARY}
    idf = {w: np.log((len(docs) + 1) / (df[w] + 1)) for w in VOCABULARY}
    def vec(ts):
        v = np.array([ts.count(w) * idf[w] for w in VOCABULARY])
        n = np.linalg.norm(v)
        return v / n if n else v
    p, i = np.array([vec(t) for *_, t in post_rows]), np.array([vec(t) for *_, t in item_rows])
    return np.round(p @ i.T, 9)


@pytest.mark.parametrize("bound,shipped", [(link.INDEX_ENTRIES, link.INDEX_TERMS),
                                           (link.INDEX_ENTRIES, 5), (0, link.INDEX_TERMS)])
@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.4, 0.7])
def test_best_items_equal_brute_force(corpus, bound, shipped, threshold, monkeypatch):
    monkeypatch.setattr(link, "ROWS_PER_SALT", 7)
    monkeypatch.setattr(link, "INDEX_TERMS", shipped)
    post_rows, item_rows, posts, items, model = corpus
    scores = brute(post_rows, item_rows)
    want = {p: (int(row.argmax()), row.max()) for p, row in enumerate(scores) if row.max() > threshold}
    links = link.best_items(posts, items, model, threshold=threshold, max_entries=bound)
    got = {r["post_id"]: (r["item_id"], pytest.approx(r["similarity"], abs=1e-8)) for r in links.collect()}
    assert got == want


@pytest.mark.parametrize("bound,shipped", [(link.INDEX_ENTRIES, link.INDEX_TERMS),
                                           (link.INDEX_ENTRIES, 5), (0, link.INDEX_TERMS)])
def test_all_similarities_and_ranks(corpus, bound, shipped, monkeypatch):
    monkeypatch.setattr(link, "INDEX_TERMS", shipped)
    post_rows, item_rows, posts, items, model = corpus
    scores = brute(post_rows, item_rows)
    grouped = link.similar_items(posts, items, model, threshold=0.2, max_entries=bound).collect()
    got = {(r["post_id"], m["item_id"]) for r in grouped for m in r["matches"]}
    assert got == {(p, i) for p, i in zip(*np.nonzero(scores > 0.2))}
    ranks = link.true_item_ranks(posts, items, model, max_entries=bound).collect()
    in_index = {i for i, ts in item_rows if ts}
    want = {p: int((scores[p] > scores[p, t]).sum()) for p, t, _ in post_rows
            if scores[p].max() > 0 and t in in_index}
    assert {r["post_id"]: r["rank"] for r in ranks} == want


def test_small_blocks_give_the_same_links(corpus, monkeypatch):
    _, _, posts, items, model = corpus
    want = sorted(link.best_items(posts, items, model).collect())
    monkeypatch.setattr(link, "BLOCK_CELLS", 20)
    assert sorted(link.best_items(posts, items, model).collect()) == want


@pytest.mark.parametrize("bound", [link.INDEX_ENTRIES, 0])
def test_ties_thresholds_and_empty_texts(spark, bound):
    items = spark.createDataFrame([(7, ["a"]), (3, ["a"]), (5, ["b", "c"])], "item_id long, terms array<string>")
    posts = spark.createDataFrame(
        [(1, ["a"]), (2, ["b"]), (3, ["zzz"]), (4, [])], "post_id long, terms array<string>")
    model = fit_terms(posts.unionAll(items), form="count")
    rows = {r["post_id"]: r for r in link.best_items(posts, items, model, max_entries=bound).collect()}
    assert set(rows) == {1, 2} and rows[1]["item_id"] == 3
    equal = rows[2]["similarity"]
    kept = link.best_items(posts, items, model, threshold=equal, max_entries=bound).collect()
    assert [r["post_id"] for r in kept] == [1]
    nothing = spark.createDataFrame([], "item_id long, terms array<string>")
    assert link.best_items(posts, nothing, model, max_entries=bound).count() == 0


def test_min_active_and_string_ids(spark):
    items = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a"])], "item_id string, terms array<string>")
    posts = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a"])], "post_id string, terms array<string>")
    model = fit_terms(posts.unionAll(items), form="count")
    for bound in (0, link.INDEX_ENTRIES):
        links = link.best_items(posts, items, model, min_active=2, max_entries=bound).collect()
        assert [(r["post_id"], r["item_id"]) for r in links] == [("p", "x")]
        tied = link.best_items(
            posts.where("post_id = 'q'"), items.withColumn("terms", F.array(F.lit("a"))), model, max_entries=bound)
        assert tied.first()["item_id"] == "x"


def test_link_groups(spark):
    links = spark.createDataFrame(
        [(1, 10, 0.5), (2, 10, 0.9), (3, 10, 0.9), (4, 20, 0.3)], "post_id long, item_id long, similarity double")
    best = {r["item_id"]: r["post_id"] for r in link.best_post_per_item(links).collect()}
    assert best == {10: 2, 20: 4}
    whole = link.posts_per_item(links).collect()
    assert {r["item_id"]: [p["post_id"] for p in r["posts"]] for r in whole} == {10: [1, 2, 3], 20: [4]}
    parts = link.posts_per_item(links, posts_per_row=1)
    assert sorted(p["post_id"] for r in parts.collect() for p in r["posts"]) == [1, 2, 3, 4]
    assert link.first_posts_per_item(links, 2).count() == 3


def test_vocabulary_cap_keeps_the_most_frequent(spark):
    frame = spark.createDataFrame([(["a"] * 3 + ["b"] * 2 + ["c", "d", "e"],), (["b"],)], "terms array<string>")
    top = ranked_terms(term_statistics(frame), 3).orderBy("idx").collect()
    assert [(r["term"], r["corpus_count"]) for r in top] == [("a", 3), ("b", 3), ("c", 1)]
    assert fit_terms(frame, min_df=2).vocabulary.first()["term"] == "b"
    with pytest.raises(ValueError):
        fit_terms(frame, form="other")


def test_number_rows_are_dense_and_ordered(spark):
    frame = spark.range(1000).selectExpr("id * 37 % 1009 AS k")
    rows = number_rows(frame, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1000))


def test_dense_links_by_blocks(spark):
    rng = np.random.default_rng(5)
    p, i = rng.normal(size=(60, 4)), rng.normal(size=(17, 4))
    posts = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(p)], "post_id long, vector array<double>")
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "item_id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(p) @ unit(i).T
    want = {k: int(r.argmax()) for k, r in enumerate(scores) if r.max() > 0.5}
    for limit in (factor.BLOCK_BYTES, 100):
        links = factor.best_dense(posts, items, threshold=0.5, block_bytes=limit).collect()
        assert {r["post_id"]: r["item_id"] for r in links} == want


def test_dense_ranks_match_brute_force(spark):
    rng = np.random.default_rng(6)
    p, i = rng.normal(size=(50, 4)), rng.normal(size=(13, 4))
    posts = spark.createDataFrame([(k, k % 15, v.tolist()) for k, v in enumerate(p)],
                                  "post_id long, true_item_id long, vector array<double>")
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "item_id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(p) @ unit(i).T
    want = {k: (int(r.argmax()), int((r > r[k % 15]).sum())) for k, r in enumerate(scores) if k % 15 < 13}
    for limit in (factor.BLOCK_BYTES, 100):
        ranks = factor.dense_ranks(posts, items, block_bytes=limit).collect()
        assert {r["post_id"]: (r["item_id"], r["rank"]) for r in ranks} == want


def _tied(spark, kind, names):
    """Items with one and the same text or vector."""
    posts = spark.createDataFrame([(7, ["x", "y"], [1.0, 2.0])],
                                  "post_id long, terms array<string>, vector array<double>")
    items = spark.createDataFrame([(n, ["x", "y"], [1.0, 2.0]) for n in names],
                                  "item_id string, terms array<string>, vector array<double>")
    return posts, items.withColumn("item_id", F.col("item_id").cast(kind))


@pytest.mark.parametrize("kind,names,first", [
    ("string", ["b", "ab", "a"], "a"), ("string", ["bc", "b"], "b"), ("smallint", ["3", "-2", "10"], -2),
    ("long", ["3", "2"], 2)])
def test_ties_go_to_the_smallest_id_in_every_path(spark, kind, names, first):
    posts, items = _tied(spark, kind, names)
    model = fit_terms(posts.select("terms").unionAll(items.select("terms")), form="count")
    for entries in (0, link.INDEX_ENTRIES):
        got = link.best_items(posts, items, model, max_entries=entries).collect()
        assert [r["item_id"] for r in got] == [first]
    for size in (16, factor.BLOCK_BYTES):
        got = factor.best_dense(posts, items, block_bytes=size).collect()
        assert [r["item_id"] for r in got] == [first]
    links = items.select(F.lit(1).alias("item"), F.col("item_id").alias("post_id"), F.lit(0.5).alias("similarity"))
    assert link.best_post_per_item(links, item_key="item").first()["post_id"] == first


def test_vocabulary_keeps_every_term(spark):
    frame = spark.range(3000).select(F.array(F.concat(F.lit("t"), F.col("id").cast("string")), F.lit("all")).alias("terms"))
    model = fit_terms(frame, form="count")
    rows = model.vocabulary.orderBy("idx").collect()
    assert model.size == 3001 and [r["idx"] for r in rows] == list(range(3001)) and rows[0]["term"] == "all"


def test_term_space_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((40, 12)) < 0.4, rng.random((40, 12)), 0.0)
    cells = [(r, int(c), float(x[r, c])) for r in range(40) for c in np.flatnonzero(x[r])]
    rows = packed(spark.createDataFrame(cells, "key long, idx int, weight double"), "key")
    space = factor.fit_term_space(rows, 12, 5)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(space.values, s[:5])
    got = {r["key"]: r["vector"] for r in space.project(rows, "key", 12, k=3).collect()}
    want = x @ vt.T[:, :3] * s[:3]
    for key, vector in got.items():
        assert np.allclose(np.abs(vector), np.abs(want[key]))
    with pytest.raises(ValueError):
        space.project(rows, "key", 12, k=6)
    with pytest.raises(ValueError):
        factor.fit_term_space(rows, 12, 13)


def test_factors_recover_blocks(spark):
    cells = [(f"d{d}", int(t + 10 * (d % 2)), 1.0) for d in range(20) for t in range(10) if (d + t) % 3]
    vectors = factor.implicit_factors(
        spark.createDataFrame(cells, "key string, idx int, weight double"), "key", rank=4, iterations=5)
    v = {r["key"]: np.array(r["vector"]) for r in vectors.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    own, other = cos(v["d0"], v["d2"]), abs(cos(v["d0"], v["d1"]))
    assert len(v) == 20 and own > 0.6 > other  # d0 and d2 share some words, d0 and d1 none


def _odd_cells():
    """Documents with terms of their own, shared ones, equal columns, repeated cells, zeros, a null key."""
    rng = np.random.default_rng(1)
    cells = [("d5", 3, 1.0), ("d5", 3, 1.0), (None, 3, 1.0), (None, 5, 2.0), ("y", 7, -1.5), ("y", 8, 1.0),
             ("z", 9000, 0.0)]
    for d in range(80):
        cells += [(f"d{d}", int(t), 1.5) for t in rng.choice(40, 9, replace=False)]
        cells += [(f"d{d}", 1000 + 20 * d + t, 2.0 if t % 4 else 4.0) for t in range(20)]
        cells += [(f"d{d}", 5000 + t + 100 * (d // 30), 3.0) for t in range(10) if d % 3 == 0]
        cells += [(f"d{d}", 9000, 0.0), (f"d{d}", 9001, 0.5)]
    return cells


@pytest.mark.parametrize("rank", [3, 16])
def test_implicit_factors_are_those_of_als(spark, monkeypatch, rank):
    cells = spark.createDataFrame(_odd_cells(), "key string, idx int, weight double")
    users = numbered_keys(cells, "key", "user")
    ratings = cells.join(users, "key").select("user", "idx", F.col("weight").cast("float").alias("weight"))
    fitted = factor.ALS(rank=rank, maxIter=3, regParam=0.05, alpha=50.0, implicitPrefs=True, userCol="user",
                        itemCol="idx", ratingCol="weight", seed=11).fit(ratings)
    want = {r["key"]: r["features"] for r in users.join(
        fitted.userFactors.withColumnRenamed("id", "user"), "user").collect()}
    rated = []
    fit = factor.ALS.fit
    monkeypatch.setattr(factor.ALS, "fit", lambda self, rows: rated.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(factor, "LEAST_CELLS", 100)
    monkeypatch.setattr(factor, "COLUMN_ROWS", 50)
    got = {r["key"]: r["vector"] for r in factor.implicit_factors(
        cells, "key", rank=rank, iterations=3, shift=1.0).collect()}
    assert got.keys() == want.keys() and len(got) == 82
    for key, vector in got.items():
        assert np.allclose(np.array(vector) - 1.0, want[key], atol=1e-4)
    assert rated == [82]  # the start alone is asked of ALS, which keeps a factor of every term


def test_equal_columns_are_kept_once(spark):
    cells = spark.createDataFrame(
        [(t, int(k[1:]), w) for k, t, w in _odd_cells() if k and k[1:]], "item int, user int, rating float")
    columns = factor._distinct_columns(cells)
    want = {}
    for row in cells.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("user", "rating"))).alias(
            "c")).collect():
        column = b"".join(np.int32(np.float32(r["rating"]).view(np.int32)).tobytes()
                          + np.int32(r["user"]).tobytes() for r in row["c"])
        want[column] = want.get(column, 0) + 1
    assert {bytes(r["column"]): r["m"] for r in columns.collect()} == want
    # the 1600 terms of one document each are two columns of each document
    assert sum(m for c, m in want.items() if len(c) == 8) == 1600
    assert len([c for c in want if len(c) == 8]) == 160


def test_writing_a_table_leaves_no_shuffle_files(spark):
    import time

    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(
            ).getAllFiles().size()

    before, setting = files(), spark.conf.get(CLEANUP_CONF)
    rows = landed(spark.range(1000).repartition(7).groupBy("id").count(), "counted")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANUP_CONF) == setting
    assert rows.count() == 1000
    dropped(rows)
    assert not [f for f in rows.inputFiles() if os.path.exists(f.removeprefix("file:"))]


def test_runs_of_words_are_not_written(spark):
    posts = spark.createDataFrame([(1, "red green blue grey"), (2, None)], "post_id long, text string")
    items = spark.createDataFrame([(1, "green blue grey")], "item_id long, text string")
    p, i, model = term_corpus(posts, items, n=3)
    assert {r["post_id"]: r["terms"] for r in p.collect()} == {1: ["red green blue", "green blue grey"], 2: []}
    assert spark.read.parquet(*p.inputFiles()).where("post_id = 1").first()["terms"] == [
        "red", "green", "blue", "grey"]
    weights = {r["term"]: (r["idx"], r["weight"]) for r in model.unranked_weights(i).collect()}
    assert set(weights) == {"green blue grey"}
    assert model.unranked_weights(p).select("idx").distinct().count() == 2


def test_terms_in_buckets_are_joined_where_they_lie(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [str(t) for t in rng.choice(VOCABULARY, 6)]) for i in range(40)],
                                 "id long, terms array<string>")
    plain, dealt = fit_terms(rows), fit_terms(rows, in_buckets=True)
    assert sorted(plain.terms.collect()) == sorted(dealt.terms.collect()) and plain.size == dealt.size
    want = {(r["id"], r["term"]): r["weight"] for r in plain.weights(rows).collect()}
    got = dealt.unranked_weights(rows).collect()
    assert {(r["id"], r["term"]): r["weight"] for r in got} == want and len(got) == len(want)
    assert len({r["idx"] for r in got}) == len({(r["term"], r["idx"]) for r in got}) == plain.size

    def shuffles(model):
        known = model.terms.withColumn("idx", F.monotonically_increasing_id())
        left = rows.select("id", F.explode("terms").alias("term"))
        plan = left.join(known.hint("merge"), "term")._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert (shuffles(plain), shuffles(dealt)) == (2, 1)


def test_task_functions_need_no_package_on_executors(tmp_path):
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = (link._batch_weights, link._score_blocks, factor._rows, factor._unit)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(functions))
    (tmp_path / "i").write_bytes(pickle.dumps(link.ItemIndex(items=np.arange(2))))
    code = "import pickle; print(len(pickle.load(open('f', 'rb'))), len(pickle.load(open('i', 'rb')).items))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin"}, timeout=60)
    assert run.stdout.split() == ["4", "2"], run.stderr


def _clustered(rng, n, centres):
    own = centres[rng.integers(0, len(centres), n)]
    return own + 0.02 * rng.normal(size=own.shape)


def test_pruned_blocks_give_the_links_of_all_blocks(spark, monkeypatch):
    from catalink.operators import dense

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 6))
    p, i = _clustered(rng, 150, centres), _clustered(rng, 900, centres)
    i[100:110], p[3], i[5] = i[99], 0.0, 0.0  # ties and vectors without length
    posts = spark.createDataFrame([(k, 2 * k, v.tolist()) for k, v in enumerate(p)],
                                  "post_id long, true_item_id long, vector array<double>")
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)],
                                  "item_id long, vector array<double>")
    length = lambda m: np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round((p / length(p)) @ (i / length(i)).T, 9)
    counted, plain = [], dense._pairs

    def pairs(left, summaries, width, nearest):
        out = plain(left, summaries, width, nearest)
        if not nearest:
            counted.append((out.count(), left.count() * len(summaries[0][0])))
        return out

    monkeypatch.setattr(dense, "_pairs", pairs)
    got = {r["post_id"]: (r["item_id"], round(r["similarity"], 9))
           for r in factor.best_dense(posts, items, block_bytes=1500).collect()}
    assert got == {k: (int(r.argmax()), round(r.max(), 9)) for k, r in enumerate(scores) if r.max() > 0}
    ranks = {r["post_id"]: r["rank"] for r in factor.dense_ranks(posts, items, block_bytes=1500).collect()}
    assert ranks == {k: int((r > r[2 * k] + 1.5e-9).sum()) for k, r in enumerate(scores)}
    (links, all_links), _ = counted
    assert links < all_links / 3


def test_dense_groups_are_matched_within_themselves(spark):
    rng = np.random.default_rng(10)
    rows = [(g, k, rng.normal(size=3 + g).tolist()) for g in range(3) for k in range(20)]
    posts = spark.createDataFrame([(g, k, k, v) for g, k, v in rows[::2]],
                                  "g int, post_id long, true_item_id long, vector array<double>")
    items = spark.createDataFrame(rows, "g int, item_id long, vector array<double>")
    got = factor.best_dense(posts, items, by="g").collect()
    assert len(got) == 30 and all(r["post_id"] == r["item_id"] for r in got)
    got = factor.dense_ranks(posts, items, by="g", block_bytes=200).collect()
    assert len(got) == 30 and {r["rank"] for r in got} == {0}
    assert factor.best_dense(posts.limit(0), items, by="g").collect() == []
    assert factor.best_dense(posts, items.limit(0)).collect() == []


def test_scoring_is_dealt_to_tasks_by_posts_times_items(corpus, monkeypatch):
    post_rows, item_rows, posts, items, model = corpus
    scores = brute(post_rows, item_rows)
    monkeypatch.setattr(link, "TASK_CELLS", 100)
    links = link.best_items(posts.coalesce(1), items, model)
    assert links.rdd.getNumPartitions() >= 200 * 12 // 100 - 1
    assert {r["post_id"]: r["item_id"] for r in links.collect()} == {
        p: int(row.argmax()) for p, row in enumerate(scores) if row.max() > 0}


def test_lengths_are_worked_out_for_possible_posts_only(corpus, monkeypatch):
    post_rows, item_rows, posts, items, model = corpus
    monkeypatch.setattr(link, "INDEX_TERMS", 5)
    seen, plain = {}, link.landed

    def landed(df, label):
        seen[label] = plain(df, label)
        return seen[label]

    monkeypatch.setattr(link, "landed", landed)
    links = link.best_items(posts, items, model, threshold=0.7).count()
    assert links <= seen["possible-posts"].count() < len(post_rows)


def test_the_index_holds_terms_in_one_buffer_and_batches_are_cut(corpus, monkeypatch):
    import pyarrow as pa

    from catalink.operators import vectorize

    _, _, posts, items, model = corpus
    index = link._shipped_index(items, "item_id", model, 0, link.INDEX_ENTRIES)[0].value
    assert isinstance(index.terms, pa.Array) and len(index.terms) == model.size
    monkeypatch.setattr(vectorize, "PART_TERMS", 10)
    runs = pa.array([[{"term": "a", "tf": 1}] * n for n in (4, 5, 30, 0, 10, 1)] + [None])
    parts = list(vectorize.run_parts([pa.record_batch([runs], ["runs"])]))
    assert [p.num_rows for p in parts] == [2, 1, 2, 2] and sum(p.num_rows for p in parts) == 7


@pytest.mark.parametrize("bound", [9, 25])
def test_items_beyond_one_index_are_scored_without_pair_rows(corpus, bound, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs are written")

    monkeypatch.setattr(link, "_joined_pairs", pairs)
    monkeypatch.setattr(link, "TASK_CELLS", 500)
    post_rows, item_rows, posts, items, model = corpus
    scores = brute(post_rows, item_rows)
    active = {p for p, _, ts in post_rows if len(set(ts)) >= 2}
    usable = np.array([len(set(ts)) >= 2 for _, ts in item_rows])
    kept = np.where(usable, scores, 0.0)
    links = link.best_items(posts, items, model, min_active=2, max_entries=bound).collect()
    assert {r["post_id"]: (r["item_id"], pytest.approx(r["similarity"], abs=1e-8)) for r in links} == {
        p: (int(row.argmax()), row.max()) for p, row in enumerate(kept) if p in active and row.max() > 0}
    ranks = link.true_item_ranks(posts, items, model, max_entries=bound)
    assert ranks.schema == link.true_item_ranks(posts, items, model).schema
    in_index = {i for i, ts in item_rows if ts}
    assert {r["post_id"]: (r["true_item_id"], r["item_id"], r["rank"]) for r in ranks.collect()} == {
        p: (t, int(scores[p].argmax()), int((scores[p] > scores[p, t]).sum()))
        for p, t, _ in post_rows if scores[p].max() > 0 and t in in_index}


def test_repeated_and_missing_ids_count_as_rows_beyond_one_index_too(spark):
    items = spark.createDataFrame([(k, [f"w{k}", "w9", "w0"]) for k in range(6)], "item_id long, terms array<string>")
    posts = spark.createDataFrame(
        [(1, 2, ["w2", "w9"]), (1, 2, ["w2", "w9"]), (1, 3, ["w4"]), (None, 5, ["w5", "w0"]), (7, None, ["w1"])],
        "post_id long, true_item_id long, terms array<string>")
    model = fit_terms(posts.select("terms").unionAll(items.select("terms")))
    for make in (link.best_items, link.true_item_ranks):
        rows = [sorted(map(str, make(posts.coalesce(1), items, model, **bound).collect()))
                for bound in ({}, {"max_entries": 5})]
        assert rows[0] == rows[1]
