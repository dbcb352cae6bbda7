import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.functions.ids import fold_of, seeded_key
from catalink.operators import features, joins, keywords, labels, metrics, sampling
from catalink.sources import readers, sinks


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("bound", [1000, 0])
def test_lookup_join_with_a_hot_key(spark, how, bound):
    left = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id % 50) AS k")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 50, 2)] + [(0, "again")], "k long, v string")
    got = joins.lookup_join(left, right, "k", how, broadcast_rows=bound, rows_per_salt=100)
    want = left.join(right, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_membership_and_insert_ignore(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("c", 7)], "k string, v int")
    known = spark.createDataFrame([("c",)], "k string")
    new = joins.insert_ignore(rows, known, "k").collect()
    assert sorted((r["k"], r["v"]) for r in new) == [("a", 1), ("b", 5)]
    present = joins.exists_in(spark.createDataFrame([("c",), ("x",)], "k string"), known, "k")
    assert {r["k"]: r["present"] for r in present.collect()} == {"c": True, "x": False}
    sides = spark.createDataFrame([(1, "m"), (1, "t"), (2, "m"), (1, "t")], "id int, side string")
    assert joins.two_sided(sides, "id").count() == 3


@pytest.mark.parametrize("method", features.REDUCERS)
def test_reducers_with_a_hot_app(spark, method):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else f"a{i % 7}", [float(v) for v in rng.normal(size=2) * 5] + [float(i % 4)])
            for i in range(300)]
    frame = spark.createDataFrame(rows, "post_id long, app_id string, vector array<double>")
    reduce = {"head": lambda c: c[0], "average": statistics.fmean, "median": statistics.median, "sum": sum}[method]
    got = {r["app_id"]: r["vector"] for r in features.reduce_vectors(frame, method).collect()}
    for app in {r[1] for r in rows}:
        own = [r[2] for r in rows if r[1] == app]
        assert got[app] == pytest.approx([reduce([v[k] for v in own]) for k in range(3)] + [len(own)])
    with pytest.raises(ValueError):
        features.reduce_vectors(frame, "mode")


def test_labels_from_counts(spark):
    counts = spark.createDataFrame([(c,) for c in (-1, None, 0, 1, 2, 3, 5, 10)], "c int")
    for threshold, positive in ((3, {3, 5, 10}), (5, {5, 10}), (10, {10})):
        rows = labels.with_labels(counts, "c", threshold).collect()
        assert {r["c"]: r["label"] for r in rows} == {0: 0.0, **{c: 1.0 for c in positive}}


def test_scan_change_counters(spark):
    rows = [("a", 0, 12), ("b", 10, 0), ("c", 3, 3), ("d", 5, 2)]
    row = labels.scan_change_counters(spark.createDataFrame(rows, "md5 string, old int, new int")).first()
    assert row.asDict() == {"considered": 4, "changed": 3, "downgraded": 2, "upgraded": 1,
                            "clean_to_flagged": 1, "flagged_to_clean": 1}


def test_numeric_features_refuse_text(spark):
    frame = spark.createDataFrame([(1, True, 2, "x")], "id long, b boolean, n int, s string")
    with pytest.raises(TypeError):
        labels.numeric_array(frame)
    assert frame.drop("s").select(labels.numeric_array(frame.drop("s"))).first()[0] == [1.0, 2.0]


# ---------------------------------------------------------------- metrics

def areas_of(spark, rows):
    ranks = spark.createDataFrame(rows, "rank int, confidence double")
    return metrics.areas(metrics.curve(metrics.scored_ranks(ranks))).first()


def test_areas(spark):
    assert areas_of(spark, [(0, 0.9), (0, 0.5)])["auprc"] == pytest.approx(1.0)
    assert areas_of(spark, [(1, 0.9), (2, 0.5)])["auprc"] == pytest.approx(0.0)
    single = areas_of(spark, [(0, 0.4)])
    assert single["auprc"] == pytest.approx(1.0)
    tied = areas_of(spark, [(0, 0.5), (1, 0.5)])
    assert tied["auprc"] == pytest.approx(0.75) and tied["auroc"] == pytest.approx(0.5)
    ordered = areas_of(spark, [(0, 1.0), (1, 0.8), (0, 0.6), (1, 0.2)])
    assert ordered["auroc"] == pytest.approx(0.75)


def test_link_and_ranking_quality(spark):
    links = spark.createDataFrame(
        [(0, 0.8, 1), (1, 0.6, 1), (0, 0.4, 2), (3, 0.2, 3)], "rank int, confidence double, item_id int")
    got = {r["metric"]: r["value"] for r in metrics.link_quality(links).collect()}
    assert (got["n_links"], got["n_right"], got["n_items"], got["n_items_right"]) == (4, 2, 3, 2)
    assert got["odds"] == 1 and got["accuracy"] == 0.5 and got["mean_confidence_wrong"] == pytest.approx(0.4)
    ranks = {r["metric"]: r["value"] for r in metrics.ranking_quality(links).collect()}
    assert ranks["n_exact"] == 2 and ranks["recall_0.3"] == 0.75
    assert ranks["stddev"] == pytest.approx(statistics.pstdev([0.8, 0.6, 0.4, 0.2]))
    kept = metrics.accepted(links, 0.5)
    assert kept.count() == 2
    pick = metrics.lowest_threshold(links, 0.6).first()
    assert pick["n_kept"] == 3 and pick["threshold"] == pytest.approx(0.4, abs=1e-3)


# ---------------------------------------------------------------- sampling

def test_undersample_counts(spark):
    rows = spark.range(1000).selectExpr("id", "IF(id % 10 = 0, 1.0D, 0.0D) AS label")
    counts = {r["label"]: r["count"] for r in sampling.undersample(rows, "id").groupBy("label").count().collect()}
    assert counts == {1.0: 100, 0.0: 100}
    few = rows.where("label = 1 OR id < 20")
    counts = {r["label"]: r["count"] for r in sampling.undersample(few, "id").groupBy("label").count().collect()}
    assert counts == {1.0: 100, 0.0: 18}


def test_selection_takes_the_smallest_draws(spark):
    rows = spark.range(5000)
    got = {r["id"] for r in sampling.smallest_by_seed(rows, "id", 777, 5).collect()}
    order = rows.select("id", seeded_key(F.col("id"), 5).alias("d")).orderBy("d", "id").limit(777)
    assert got == {r["id"] for r in order.collect()}


def test_folds_partition_the_rows(spark):
    rows = spark.range(2000).select("id", fold_of(F.col("id")).alias("fold"))
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    assert set(sizes) == set(range(5)) and min(sizes.values()) > 300


# ---------------------------------------------------------------- keywords

def test_phrases(spark):
    rows = spark.createDataFrame(
        [(["Angry Birds Space", "Rovio"],), (["Lost Title", "unfound"],), (["it", "the", "ab"],)], "fields array<string>")
    phrases = keywords.phrase_dictionary(rows)
    assert {r["phrase"] for r in phrases.collect()} == {"angry birds space", "rovio"}
    posts = spark.createDataFrame(
        [(1, "I love angry and the birds space now"), (2, "angry purple birds space"), (3, "Rovio rocks")],
        "post_id long, text string")
    assert {r["post_id"] for r in keywords.phrase_matches(posts, phrases).collect()} == {1, 3}
    words = keywords.unique_words(spark.createDataFrame([("one two",), ("two three!",)], "phrase string"))
    assert {r["word"] for r in words.collect()} == {"one", "three"}


def test_post_keywords_keep_the_heaviest_fifth(spark):
    posts = spark.createDataFrame(
        [(1, ["common"] * 4 + ["rare"]), (2, ["common"] * 5), (3, ["x"] * 4)], "post_id long, tokens array<string>")
    got = {(r["post_id"], r["term"], r["copies"]) for r in keywords.post_keywords(posts).collect()}
    # In post 1 "common" weighs 4 ln(4/3) = 1.15 and "rare" ln(4/2) = 0.69; a fifth of the four
    # tokens of post 3 is none.
    assert got == {(1, "common", 1), (2, "common", 1)}


def test_token_app_matches(spark):
    wanted = spark.createDataFrame([(1, "Maps"), (1, "maps"), (2, "other")], "post_id long, term string")
    apps = spark.createDataFrame([("a", ["Maps", "go"]), ("b", ["MAPS"])], "app_id string, words array<string>")
    got = {tuple(r) for r in keywords.token_app_matches(wanted, apps).collect()}
    assert got == {(1, "Maps", "a"), (1, "Maps", "b")}


# ---------------------------------------------------------------- files

def test_keyword_and_description_files(spark, tmp_path):
    (tmp_path / "ben").write_text("Angry Birds\tRovio\tcom.rovio\n")
    (tmp_path / "mal").write_text("(x.apk,com.bad,Bad App)\n(y.apk)\n")
    rows = readers.read_keywords(spark, str(tmp_path / "ben"), str(tmp_path / "mal")).collect()
    assert sorted((r["kind"], r["fields"]) for r in rows) == [
        ("benign", ["Angry Birds", "Rovio", "com.rovio"]), ("malware", []), ("malware", ["com.bad", "Bad App"])]
    (tmp_path / "desc").write_text("a.b,<p>Hi, <b>you</b></p>\nno comma\n")
    rows = readers.read_descriptions(spark, str(tmp_path / "desc")).collect()
    assert [tuple(r) for r in rows] == [("a.b", "Hi, you")]


def test_post_lines_set_rejects_apart(spark, tmp_path):
    lines = [json.dumps({"id": 1, "text": "a", "urlEntities": [{"expandedURL": "u"}]}), '{"id": 2, "te', "", "{}"]
    (tmp_path / "posts").write_text("\n".join(lines))
    good, bad = readers.read_post_lines(spark, str(tmp_path / "posts"))
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 3


def test_feature_catalogue_and_tuple_files(spark, tmp_path):
    (tmp_path / "f").write_text("apk,f1,f2\n/d/x.y.apk,1,0\nname,ACTION_PACKAGE_RESTARTED\n")
    assert [tuple(r) for r in readers.read_feature_lines(spark, str(tmp_path / "f")).collect()] == [("x.y", [1.0, 0.0])]
    head = "sha256,sha1,md5,dex_date,apk_size,pkg_name,vercode,vt_detection,vt_scan_date,dex_size,markets\n"
    (tmp_path / "c").write_text(
        head + "s1,h,m1,2016-02-01,1,p,1,4,2016,1,play.google.com\ns2,h,m2,2016-02-01,1,p,1,,2016,1,play.google.com|anzhi\n"
        "s3,h,m3,2015-02-01,1,p,1,0,2016,1,play.google.com\n")
    catalogue = readers.read_catalogue(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in readers.market_year(catalogue).collect()] == [("s1", "m1")]
    assert {r["sha256"]: r["count"] for r in readers.detections(catalogue).collect()} == {"s1": 4, "s2": -1, "s3": 0}
    (tmp_path / "t").write_text("(a,1,2)\n(b,3,4)\n")
    rows = readers.read_tuples(spark, str(tmp_path / "t"), "md5 STRING, old INT, new INT").collect()
    assert [tuple(r) for r in rows] == [("a", 1, 2), ("b", 3, 4)]


def test_scan_and_metadata_files(spark, tmp_path):
    scans, metas = tmp_path / "scans", tmp_path / "metas"
    scans.mkdir(), metas.mkdir()
    (scans / "m1.json").write_text('{"report": [1, {"a": "Trojan", "b": "", "c": "Bad"}]}')
    (scans / "m2.json").write_text('{"report": [1')
    (scans / "m3.json").write_text('{"report": [1]}')
    (metas / "x.json").write_text('{\n "apk": {"md5sum": "m1", "package": "com.a", "more": 1}\n}')
    (metas / "y.json").write_text('{"apk": {"md5sum": "m2", "package": "com.b"}}')
    ids = readers.read_store_metadata(spark, str(metas))
    assert {tuple(r) for r in ids.collect()} == {("m1", "com.a"), ("m2", "com.b")}
    rows = readers.parse_scans_v1(readers.read_report_files(spark, str(scans)), ids).collect()
    assert [tuple(r) for r in rows] == [("com.a", "m1", 2)]
    totals = spark.createDataFrame([("n", '{"resource": "r", "positives": 3.9}'), ("o", "{")], "name string, body string")
    assert [tuple(r) for r in readers.parse_scans_v2(totals).collect()] == [("n", "r", 3)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("k", "v")], "key string, text string")
    sinks.write_lines(frame, str(tmp_path / "lines"), F.concat("key", "text"), files=3)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["kv"]
    again = sinks.write_cache(frame, str(tmp_path / "cache"))
    assert again.collect() == frame.collect()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_with_keys_hot_on_both_sides(spark, how):
    """One key holds nine tenths of either side."""
    left = spark.range(500).selectExpr("id", "IF(id % 10 < 9, 0, id) AS k")
    right = spark.range(300).selectExpr("id AS r", "IF(id % 10 < 9, 0, id + 200) AS k")
    got = joins.lookup_join(left, right, "k", how, broadcast_rows=0, rows_per_salt=50)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from catalink.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))
