"""Streams driven to completion over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalink import schemas
from catalink.operators import keywords
from catalink.plans import sqltext as sq, tables as tb
from catalink.plans.registry import query
from catalink.plans.text_queries import PHRASES_SQL
from catalink.session import landed, scratch_path
from catalink.sources import readers
from catalink.streaming import jobs

EVENTS = "events.parquet"
# Bytes of text in a landed file of posts, and batches the files are taken in.
LANDED_BYTES, BATCHES = 64_000_000, 3


def _collected(spark: SparkSession, sf_dir: str, per_set: int) -> str:
    """Run the collection over the posts landed as files; returns its output folder."""
    path = scratch_path(spark, "landed-posts")
    posts = tb.posts(spark, sf_dir)
    size = posts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(2, -(-size // (BATCHES * LANDED_BYTES)))
    posts.repartition(BATCHES * files).write.json(path)
    phrases = landed(keywords.phrase_dictionary(tb.keyword_rows(spark, sf_dir)), "phrases")
    out = scratch_path(spark, "collected")
    stream = readers.stream_posts(spark, path, files_per_batch=files)
    jobs.drain(jobs.collect(stream, phrases, out, scratch_path(spark, "progress"),
                            per_set=per_set, interval=None))
    return out


WANTED_SQL = f"""
WITH {sq.POSTS}, {PHRASES_SQL},
toks AS (SELECT id, {sq.phrase_words('text')} AS t FROM posts),
w AS (SELECT id, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM toks),
g AS (SELECT id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
hits AS (SELECT DISTINCT id FROM (
         SELECT id, a AS run FROM g UNION ALL SELECT id, a || ' ' || b FROM g UNION ALL
         SELECT id, a || ' ' || b || ' ' || c FROM g) JOIN phrases ON run = phrase)
SELECT id, lang, length(text) AS n_chars, len(urls) AS n_urls FROM posts
WHERE id IN (SELECT id FROM hits) OR contains(array_to_string(urls, ' '), 'play.google')
"""


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", "lang", F.length("text").cast("long").alias("n_chars"),
                       F.size("urlEntities").alias("n_urls"))


@query(WANTED_SQL)
def stream_collection(spark, sf_dir):
    """Posts kept by the keyword stream, some of its parts merged and some still waiting."""
    out = _collected(spark, sf_dir, per_set=2)
    schema = spark.createDataFrame([], schemas.POST).schema
    return _columns(jobs.collected(spark, out, schema))


@query(WANTED_SQL)
def stream_compaction(spark, sf_dir):
    """With one batch per file set every part is merged: the merged folders hold all posts."""
    out = _collected(spark, sf_dir, per_set=1)
    return _columns(spark.read.schema(schemas.POST).option("recursiveFileLookup", "true")
                    .json(f"{out}/data"))


# Event kinds that count as good or bad news.
GOOD_EVENTS = ["purchase", "signup"]
BAD_EVENTS = ["error"]
EVENT_SCORE = """
CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END
"""


def _event_scores(events: DataFrame) -> DataFrame:
    """All events, scored by kind; sign-up kinds are one topic, the rest the other."""
    return jobs.topic_scores(
        events, ts="ts", text="event_type", needle="sign", topic="sign", other="rest",
        positive=GOOD_EVENTS, negative=BAD_EVENTS)


_WINDOWS_SQL = f"""
SELECT time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '1970-01-01') AS w,
       CASE WHEN contains(lower(event_type), 'sign') THEN 'sign' ELSE 'rest' END AS topic,
       avg({EVENT_SCORE}) AS mean, count(*) AS n
FROM events GROUP BY ALL
"""


@query(f"""
SELECT epoch(w)::BIGINT AS window_start, topic, round(mean, 6) AS mean, n FROM ({_WINDOWS_SQL})
""")
def topic_sentiment_windows(spark, sf_dir):
    """Mean score and count per topic and ten-second window, as a batch job."""
    windows = jobs.topic_windows(_event_scores(tb.table(spark, sf_dir, "events")), delay=None)
    return _windows(windows)


def _windows(windows: DataFrame) -> DataFrame:
    start = F.col("window_start").cast("timestamp_ntz")
    seconds = F.unix_timestamp(F.date_format(start, "yyyy-MM-dd HH:mm:ss")) - F.unix_timestamp(
        F.lit("1970-01-01 00:00:00"))
    return windows.select(seconds.alias("window_start"), "topic",
                          F.round("mean", 6).alias("mean"), "n")


@query(f"""
SELECT epoch(w)::BIGINT AS window_start, topic, round(mean, 6) AS mean, n FROM ({_WINDOWS_SQL})
""")
def topic_sentiment_stream(spark, sf_dir):
    """The same windows from a stream with a one-minute watermark, open ones at its end included."""
    events = readers.stream_events(spark, sf_dir, EVENTS)
    out = scratch_path(spark, "windows")
    jobs.drain(jobs.write_latest(jobs.topic_windows(_event_scores(events)), out,
                                 scratch_path(spark, "progress"), interval=None))
    return _windows(jobs.latest_windows(spark, out))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def stream_file_sink(spark, sf_dir):
    """Events streamed to files, one set per micro-batch, and read back."""
    out = scratch_path(spark, "event-files")
    events = readers.stream_events(spark, sf_dir, EVENTS).select("event_id", "event_type", "value")
    jobs.drain(jobs.write_windows(events, out, scratch_path(spark, "progress"), interval=None))
    return spark.read.parquet(out).withColumn("value", F.round("value", 6))
