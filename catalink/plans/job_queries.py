"""The end-to-end jobs, run from files as a user runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalink.plans import programs, sqltext as sq, tables as tb
from catalink.plans.link_queries import QUALITY_SQL, TALK_ITEMS, TALK_POSTS
from catalink.plans.registry import query
from catalink.session import scratch_path

_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"
_ITEMS = "SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark"


def _description_file(spark: SparkSession, sf_dir: str) -> str:
    line = F.concat_ws(",", F.col("item_id").cast("string"),
                       F.regexp_replace("text", r"[\n\r]", " "))
    return tb.stored_lines(tb.item_texts(spark, sf_dir), line, "descriptions")


@query(f"""
WITH {sq.weights(_DOCS, _ITEMS, 2)}, {sq.similarities()}, {sq.links(0.1)}
SELECT CAST(post_id AS BIGINT) AS post_id, item_id, round(s, 6) AS similarity FROM links
""")
def full_linking(spark, sf_dir) -> DataFrame:
    """Posts linked to descriptions, both read from files; item ids are strings."""
    links = programs.full_linking(
        spark, tb.stored_posts(spark, sf_dir), _description_file(spark, sf_dir), threshold=0.1,
        text=programs.TextOptions(n=1, min_df=2, min_active=0),
        factors=programs.FactorOptions(rank=0))
    return links.withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {tb.KEYWORD_ROWS_SQL},
phrases AS (SELECT unnest(fields) AS phrase FROM keyword_rows),
k AS (SELECT word FROM (SELECT unnest({sq.prepared('phrase')}) AS word FROM phrases)
      GROUP BY word HAVING count(*) = 1),
p AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({sq.prepared('text')}) AS word FROM documents))
SELECT doc_id AS post_id, count(*) AS n_hits FROM p JOIN k USING (word) GROUP BY doc_id
""")
def keyword_links(spark, sf_dir) -> DataFrame:
    """Posts that hold a word of one keyword file entry only."""
    return programs.keyword_links(
        spark, tb.stored_posts(spark, sf_dir),
        tb.stored_lines(tb.benign_lines(spark, sf_dir), F.col("value"), "benign"),
        tb.stored_lines(tb.malware_lines(spark, sf_dir), F.col("value"), "malware"))


@query(f"""
WITH {sq.weights(TALK_POSTS, TALK_ITEMS, 2)},
{sq.similarities(10).replace("sims AS", "all_sims AS")},
apps AS (SELECT id FROM norm WHERE side = 'i' AND active >= 10 INTERSECT
         SELECT id // 1000 FROM norm WHERE side = 'p' AND active >= 10),
sims AS (SELECT * FROM all_sims WHERE item_id IN (SELECT id FROM apps)
         AND post_id // 1000 IN (SELECT id FROM apps)), {sq.links(0.0)},
graded AS (SELECT post_id, item_id, post_id // 1000 AS true_item_id, s AS confidence,
                  CASE WHEN item_id = post_id // 1000 THEN 0 ELSE 1 END AS rank FROM links),
{QUALITY_SQL}
SELECT metric, round(value, 6) AS value FROM m
""")
def ground_truth(spark, sf_dir) -> DataFrame:
    """Quality of linking posts with a known item, among apps active on both sides."""
    quality = programs.ground_truth(*tb.talk_texts(spark, sf_dir),
                                    programs.TextOptions(n=1, min_df=2))
    return quality.withColumn("value", F.round("value", 6))


@query(f"""
WITH {tb.CATALOGUE_SQL}, {tb.SEEN_SQL}
SELECT sha256 FROM catalogue WHERE markets = 'play.google.com' AND year = '1998'
  AND sha256 NOT IN (SELECT sha256 FROM seen_sha) AND md5 NOT IN (SELECT md5 FROM seen_md5)
""")
def pending_downloads(spark, sf_dir) -> DataFrame:
    """The list of store apps not fetched yet, as written to files."""
    path, out = scratch_path(spark, "catalogue"), scratch_path(spark, "pending")
    tb.catalogue(spark, sf_dir).write.csv(path, header=True)
    programs.pending_downloads(spark, path, tb.seen_apps(spark, sf_dir), out, files=4, year="1998")
    return spark.read.text(out).withColumnRenamed("value", "sha256")
