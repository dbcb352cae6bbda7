"""Streams: keyword collection with compaction, and windowed topic sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalink.functions.ids import PRIME, seeded_key
from catalink.functions.text import topic_of
from catalink.operators.keywords import phrase_matches, written_phrases
from catalink.operators.sentiment import sentiment_mean, sentiment_score

BATCHES_PER_FILE_SET = 60
ROWS_PER_FILE = 5_000_000
# Bytes of lines in a merged file, so that no task writes more, however long the texts are.
BYTES_PER_FILE = 128_000_000
# Parts of window states that are merged into one.
STATES_PER_LEVEL = 16


def wanted_posts(posts: DataFrame, phrases: DataFrame, url_part: str = "play.google",
                 written: bool = False) -> DataFrame:
    """Posts that hold a dictionary phrase or link to ``url_part``; works on any batch.

    Only posts without a matching link are looked up in the dictionary.
    """
    by_link = F.coalesce(
        F.exists("urlEntities", lambda u: u["expandedURL"].contains(url_part)), F.lit(False))
    others = posts.where(~by_link)
    matched = phrase_matches(others, phrases, "id", "text", written=written).select("id")
    return posts.where(by_link).unionByName(others.join(matched, "id", "left_semi"))


def collect(posts: DataFrame, phrases: DataFrame, out: str, checkpoint: str, *,
            url_part: str = "play.google", per_set: int = BATCHES_PER_FILE_SET,
            interval: str | None = "60 seconds") -> StreamingQuery:
    """Write the wanted posts of every micro-batch and merge the parts of each full set.

    A batch is written to a folder named by its id with overwrite, so a repeated batch
    replaces itself. Empty batches write nothing. ``interval`` None drains what is there. The
    dictionary is written once, when the stream starts.
    """
    dictionary = written_phrases(phrases)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the emptiness test, the filter and the lookup
        if not batch.isEmpty():
            wanted_posts(batch, dictionary, url_part, written=True).write.mode("overwrite").json(
                part_path(out, batch_id))
        batch.unpersist()
        if (batch_id + 1) % per_set == 0:
            compact(batch.sparkSession, out, batch_id // per_set, per_set, posts.schema)

    writer = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(writer, interval)


def _start(writer, interval: str | None) -> StreamingQuery:
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def part_path(out: str, batch_id: int) -> str:
    return f"{out}/parts/part_{batch_id:09d}"


def compact(spark: SparkSession, out: str, file_set: int, per_set: int, schema,
            rows_per_file: int = ROWS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> bool:
    """Merge the parts of one file set into one folder, then retire them.

    Parts are removed only after the merged folder was committed. When it already was, a
    rerun only finishes the removal, so running this twice changes nothing.
    """
    merged = f"{out}/data/set_{file_set:06d}"
    ids = range(file_set * per_set, (file_set + 1) * per_set)
    parts = [p for p in (part_path(out, i) for i in ids) if _exists(spark, p)]
    if not _exists(spark, f"{merged}/_SUCCESS"):
        if not parts:
            return False
        rows = spark.read.schema(schema).json(parts)
        size = sum(_size(spark, p) for p in parts)
        files = max(1, -(-rows.count() // rows_per_file), -(-size // bytes_per_file))
        rows.repartition(files).write.mode("overwrite").json(merged)
    for part in parts:
        _remove(spark, part)
    return True


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop_path(spark, path)
    return files.exists(target)


def _size(spark: SparkSession, path: str) -> int:
    target, files = _hadoop_path(spark, path)
    return files.getContentSummary(target).getLength()


def _remove(spark: SparkSession, path: str) -> None:
    target, files = _hadoop_path(spark, path)
    files.delete(target, True)


def collected(spark: SparkSession, out: str, schema) -> DataFrame:
    """All collected posts: merged sets and the parts still waiting."""
    folders = [f"{out}/{kind}" for kind in ("data", "parts") if _exists(spark, f"{out}/{kind}")]
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return reader.json(folders) if folders else spark.createDataFrame([], schema)


# ---------------------------------------------------------------- topic sentiment

def topic_scores(events: DataFrame, *, ts: str, text: str, needle: str, topic: str, other: str,
                 key: str | None = None, fraction: float = 1.0, seed: int = 11,
                 positive: Sequence[str] | None = None, negative: Sequence[str] | None = None,
                 ) -> DataFrame:
    """(ts, topic, score) of a (sampled) stream or table of texts."""
    lexicon = {}
    if positive is not None:
        lexicon["positive"] = positive
    if negative is not None:
        lexicon["negative"] = negative
    # Watermarks need a zoned timestamp; a zoneless one is read in the session's time zone.
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if fraction < 1.0:
        rows = rows.where(seeded_key(F.col(key), seed) < F.lit(int(fraction * PRIME)))
    score: Column = sentiment_score(sentiment_mean(F.col(text), **lexicon))
    return rows.select(
        F.col(ts).alias("ts"), topic_of(F.col(text), needle, topic, other).alias("topic"),
        score.alias("score"))


def topic_windows(scores: DataFrame, window: str = "10 seconds",
                  delay: str | None = "1 minute") -> DataFrame:
    """(window_start, topic, mean, n); with a watermark delay on streams."""
    rows = scores if delay is None else scores.withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", window), "topic").agg(
        F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("window_start"), "topic", "mean", "n")


def write_windows(windows: DataFrame, out: str, checkpoint: str,
                  interval: str | None = "10 seconds") -> StreamingQuery:
    """Append closed windows to a table of files."""
    writer = (
        windows.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint))
    return _start(writer, interval)


def write_latest(windows: DataFrame, out: str, checkpoint: str,
                 interval: str | None = "10 seconds", fan_in: int = STATES_PER_LEVEL) -> StreamingQuery:
    """Write the windows each micro-batch changed, open ones too, and merge the parts by levels.

    A repeated batch replaces its part and finishes what was left of its merges, so nothing counts
    twice and nothing is lost.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_states(batch, out, batch_id, fan_in)

    writer = (windows.writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return _start(writer, interval)


def state_path(out: str, level: int, batch_id: int) -> str:
    return f"{out}/level={level}/batch={batch_id}"


def write_states(batch: DataFrame, out: str, batch_id: int, fan_in: int = STATES_PER_LEVEL) -> None:
    """Write one batch of window states and merge every level that is full with it.

    ``fan_in`` parts of a level become one of the next, under the number of the last, with the last
    state of each window; they are removed only after it was committed. Until then a reader finds a
    state twice, which is the same state. So the parts of n batches are some fan_in x log n.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(state_path(out, 0, batch_id))
    level, span = 0, fan_in
    while (batch_id + 1) % span == 0:
        step = span // fan_in
        numbers = range(batch_id + 1 - span + step - 1, batch_id + 1, step)
        parts = [p for p in (state_path(out, level, n) for n in numbers) if _exists(spark, p)]
        merged = state_path(out, level + 1, batch_id)
        if parts and not _exists(spark, f"{merged}/_SUCCESS"):
            states = spark.read.option("basePath", out).parquet(*parts)
            _last_states(states).write.mode("overwrite").parquet(merged)
        for part in parts:
            _remove(spark, part)
        level, span = level + 1, span * fan_in


def _last_states(states: DataFrame) -> DataFrame:
    return states.groupBy("window_start", "topic").agg(
        F.max_by(F.struct("mean", "n"), "batch").alias("last")).select(
        "window_start", "topic", "last.*")


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """(window_start, topic, mean, n): the last state written of each window."""
    return _last_states(spark.read.parquet(out))


def drain(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for a draining query and raise what it raised."""
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


