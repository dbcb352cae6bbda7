import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalink import schemas
from catalink.sources.readers import stream_posts
from catalink.streaming import jobs


def landed_posts(folder, n_files):
    folder.mkdir()
    for k in range(n_files):
        posts = [
            {"id": 10 * k, "text": "I play Angry Birds Space", "urlEntities": []},
            {"id": 10 * k + 1, "text": "nothing", "urlEntities": [{"expandedURL": "https://play.google.com/x?id=a"}]},
            {"id": 10 * k + 2, "text": "nothing", "urlEntities": [{"expandedURL": "https://other"}]},
        ]
        (folder / f"f{k}.json").write_text("\n".join(json.dumps(p) for p in posts))


def test_collection_and_compaction(spark, tmp_path):
    landed_posts(tmp_path / "in", 5)
    phrases = spark.createDataFrame([("angry birds space",)], "phrase string")
    out = str(tmp_path / "out")
    stream = stream_posts(spark, str(tmp_path / "in"), files_per_batch=1)
    jobs.drain(jobs.collect(stream, phrases, out, str(tmp_path / "progress"), per_set=2, interval=None))
    schema = spark.createDataFrame([], schemas.POST).schema
    want = sorted(10 * k + j for k in range(5) for j in (0, 1))
    ids = lambda: sorted(r["id"] for r in jobs.collected(spark, out, schema).collect())
    assert ids() == want
    assert sorted(p.name for p in (tmp_path / "out/data").iterdir()) == ["set_000000", "set_000001"]
    assert [p.name for p in (tmp_path / "out/parts").iterdir() if p.is_dir()] == ["part_000000004"]
    # Merging a set again, whether finished or interrupted before the parts went, changes nothing.
    assert not (tmp_path / "out/parts/part_000000000").exists()
    jobs.compact(spark, out, 0, 2, schema)
    spark.read.schema(schema).json(f"{out}/data/set_000000").limit(1).write.json(jobs.part_path(out, 0))
    jobs.compact(spark, out, 0, 2, schema)
    assert ids() == want
    jobs.compact(spark, out, 2, 2, schema, rows_per_file=1)
    assert ids() == want


def test_the_dictionary_is_written_once_a_stream(spark, tmp_path):
    from pathlib import Path

    from catalink.session import shared_dir

    landed_posts(tmp_path / "in", 6)
    phrases = spark.createDataFrame([("angry birds space",)] * 3, "phrase string")
    before = set(Path(shared_dir(spark)).iterdir())
    stream = stream_posts(spark, str(tmp_path / "in"), files_per_batch=1)
    jobs.drain(jobs.collect(stream, phrases, str(tmp_path / "out"), str(tmp_path / "progress"), interval=None))
    assert len({p.name for p in set(Path(shared_dir(spark)).iterdir()) - before}) == 1


def _states(spark, batch_id):
    """States of a batch: its own window, and a later state of one five batches earlier."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=10 * k), "t", float(batch_id), n) for k, n in (
        (batch_id, 1), (batch_id - 5, 2)) if k >= 0]
    return spark.createDataFrame(rows, "window_start timestamp, topic string, mean double, n long")


def test_window_states_are_merged_by_levels(spark, tmp_path):
    out = str(tmp_path / "states")
    want = {}
    for b in range(20):
        jobs.write_states(_states(spark, b), out, b, fan_in=3)
        want |= {r["window_start"]: (r["mean"], r["n"]) for r in _states(spark, b).collect()}
    rows = jobs.latest_windows(spark, out).collect()
    assert len(rows) == 20 and {r["window_start"]: (r["mean"], r["n"]) for r in rows} == want
    folders = [p for p in (tmp_path / "states").glob("level=*/batch=*")]
    assert sorted(f"{p.parent.name}/{p.name}" for p in folders) == [
        "level=0/batch=18", "level=0/batch=19", "level=2/batch=17", "level=2/batch=8"]


def test_a_kill_between_merge_and_retirement_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "states")
    for b in range(2):
        jobs.write_states(_states(spark, b), out, b, fan_in=3)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_remove", killed)
        try:
            jobs.write_states(_states(spark, 2), out, 2, fan_in=3)
        except RuntimeError:
            pass
    read = lambda: sorted(map(tuple, jobs.latest_windows(spark, out).collect()))
    found = read()
    assert len(found) == 3
    jobs.write_states(_states(spark, 2), out, 2, fan_in=3)
    assert read() == found
    assert len(list((tmp_path / "states").glob("level=*/batch=*"))) == 1


def test_late_events_are_excluded(spark, tmp_path):
    start = datetime(2024, 1, 1)
    def write(name, rows):
        spark.createDataFrame(
            [(i, start + timedelta(seconds=s), 0, e, 0.0, "") for i, s, e in rows],
            "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schemas.EVENT).parquet(str(tmp_path / "in"))
        scores = jobs.topic_scores(stream, ts="ts", text="event_type", needle="sign", topic="sign",
                                   other="rest", positive=["purchase", "signup"], negative=["error"])
        jobs.drain(jobs.write_windows(jobs.topic_windows(scores), str(tmp_path / "out"),
                                      str(tmp_path / "progress"), interval=None))

    write("a", [(1, 1, "purchase"), (2, 2, "error"), (3, 3, "signup"), (4, 200, "view")])
    run()
    write("b", [(5, 4, "purchase"), (6, 400, "view")])  # the first is older than the watermark
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    first = {r["topic"]: (r["mean"], r["n"]) for r in rows.where(
        F.col("window_start") == F.lit(start)).collect()}
    assert first == {"rest": (0.0, 2), "sign": (1.0, 1)}


def test_programs_run_end_to_end(spark, tmp_path):
    from catalink.plans import programs

    words = ["red", "blue", "fast", "slow", "game", "maps", "chat", "photo"]
    posts = [{"id": i, "text": " ".join(words[(i + k) % 8] for k in range(3)) + f" tag{i % 4}",
              "urlEntities": [{"expandedURL": f"https://play.google.com/s?id=com.a{i % 4}&hl=en"}],
              "mediaEntities": [], "inReplyToUserId": -1, "lang": "en",
              "user": {"followersCount": i, "friendsCount": 1, "favouritesCount": 2, "statusesCount": 3}}
             for i in range(80)]
    (tmp_path / "posts").write_text("\n".join(json.dumps(p) for p in posts))
    (tmp_path / "desc").write_text("\n".join(f"com.a{k},<b>tag{k}</b> words about tag{k}" for k in range(4)))
    (tmp_path / "ben").write_text("tag1 red\tme\tcom.a1\n")
    (tmp_path / "mal").write_text("(f,com.bad,red blue)\n")
    args = (spark, str(tmp_path / "posts"), str(tmp_path / "desc"))
    text = programs.TextOptions(n=1, min_active=1)
    links = programs.full_linking(*args, text=text, factors=programs.FactorOptions(rank=0), threshold=0.1)
    assert all(r["item_id"] == f"com.a{r['post_id'] % 4}" for r in links.collect()) and links.count() == 80
    dense = programs.full_linking(*args, text=text, factors=programs.FactorOptions(rank=4), threshold=0.0)
    assert 0 < dense.count() <= 80
    read = programs.readers.read_posts(spark, str(tmp_path / "posts"))
    pairs = programs.store_links(read)
    assert pairs.where("app_id = 'com.a1'").count() == 20
    hits = programs.keyword_links(spark, str(tmp_path / "posts"), str(tmp_path / "ben"), str(tmp_path / "mal"))
    assert {r["post_id"] for r in hits.collect()} >= {i for i in range(80) if i % 4 == 1}
    apps = spark.createDataFrame(
        [(f"com.a{k}", float(k % 2), [float(k)]) for k in range(4)], "app_id string, label double, features array<double>")
    joint = programs.features.linked_features(
        pairs.select("post_id", "app_id"),
        read.select(F.col("id").alias("post_id"), F.array(F.col("user.followersCount").cast("double")).alias("vector")),
        apps)
    assert {r["app_id"]: r["joint"] for r in joint.collect()}["com.a0"] == [0.0, 38.0, 20.0]
    assert programs.sentiment_features(read).count() == 4
    truth = read.select(F.col("id").alias("post_id"), F.concat(F.lit("com.a"), (F.col("id") % 4).cast("string"))
                        .alias("true_item_id"), "text")
    items = programs.readers.read_descriptions(spark, str(tmp_path / "desc")).withColumnRenamed(
        "app_id", "item_id").withColumnRenamed("description", "text")
    got = {r["metric"]: r["value"] for r in programs.ground_truth(truth, items, text).collect()}
    assert got["accuracy"] == 1.0 and got["n_links"] == 80
    programs.export_store_links(spark, str(tmp_path / "posts"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_merged_files_are_bounded_by_bytes(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).selectExpr("id", "repeat('word ', 500) AS text")
    rows.repartition(4).write.json(jobs.part_path(out, 0))
    assert jobs.compact(spark, out, 0, 1, rows.schema, bytes_per_file=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "out/data/set_000000").glob("part-*")]
    assert len(sizes) >= 5 and max(sizes) < 40_000
    assert spark.read.schema(rows.schema).json(f"{out}/data/set_000000").count() == 40


def test_posts_land_in_files_of_bounded_size_and_three_batches(spark, tmp_path, monkeypatch):
    from catalink.plans import stream_queries

    taken, plain = [], stream_queries.readers.stream_posts
    monkeypatch.setattr(stream_queries, "LANDED_BYTES", 30_000)
    monkeypatch.setattr(stream_queries.readers, "stream_posts", lambda spark, path, files_per_batch: (
        taken.append((len(spark.read.text(path).inputFiles()), files_per_batch)),
        plain(spark, path, files_per_batch=files_per_batch))[1])
    stream_queries._collected(spark, "/root/testdata/sf0.001", per_set=2)
    files, batch = taken[0]
    assert files > 6 and files == 3 * batch
