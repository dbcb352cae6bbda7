"""Sources, sinks, identifiers, labels, joins and feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalink.functions import ids
from catalink.operators import features, joins, labels, metrics
from catalink.operators.vectorize import numbered_keys
from catalink.plans import sqltext as sq, tables as tb
from catalink.plans.registry import query
from catalink.plans.tables import table
from catalink.plans.text_queries import SENTIMENT_SQL, derived_lexicon
from catalink.operators.sentiment import sentiment_means, sentiment_score
from catalink.session import landed, scratch_path
from catalink.sources import readers, sinks


# ---------------------------------------------------------------- posts

@query(f"""
WITH {sq.POSTS}
SELECT id, lang, reply_to, favorite_count, retweet_count, length(text) AS n_chars, len(urls) AS n_urls,
       coalesce(urls[1], '') AS first_url, followers FROM posts
""")
def json_posts(spark, sf_dir):
    """Posts written as JSON lines and read back with the explicit schema."""
    posts = readers.read_posts(spark, tb.stored_posts(spark, sf_dir))
    return posts.select(
        "id", "lang", F.col("inReplyToUserId").alias("reply_to"),
        F.col("favoriteCount").alias("favorite_count"), F.col("retweetCount").alias("retweet_count"),
        F.length("text").cast("long").alias("n_chars"), F.size("urlEntities").alias("n_urls"),
        F.coalesce(F.get("urlEntities", F.lit(0))["expandedURL"], F.lit("")).alias("first_url"),
        F.col("user.followersCount").alias("followers"))


def _damaged_lines(spark: SparkSession, sf_dir: str) -> str:
    """Post lines of which the Spanish ones lost their last characters."""
    line = F.to_json(F.struct(*[F.col(c) for c in tb.posts(spark, sf_dir).columns]))
    cut = F.when(F.col("lang") == "es", F.substring(line, F.lit(1), F.length(line) - 20)).otherwise(line)
    return tb.stored_lines(tb.posts(spark, sf_dir), cut, "post-lines")


@query("SELECT doc_id AS id, lang, length(text) AS n_chars FROM documents WHERE lang <> 'es'")
def post_lines(spark, sf_dir):
    """Posts parsed line by line; damaged lines are set apart."""
    good, _ = readers.read_post_lines(spark, _damaged_lines(spark, sf_dir))
    return good.select("id", "lang", F.length("text").cast("long").alias("n_chars"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'es'")
def rejected_post_lines(spark, sf_dir):
    _, bad = readers.read_post_lines(spark, _damaged_lines(spark, sf_dir))
    return bad.agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {sq.POSTS}
SELECT count(*) AS n FROM posts WHERE contains(text, 'play.google') OR contains(array_to_string(urls, ' '), 'play.google')
""")
def raw_url_lines(spark, sf_dir):
    """Raw post lines that mention the store; a substring test, no parsing."""
    lines = spark.read.text(tb.stored_posts(spark, sf_dir))
    return lines.where(F.col("value").contains("play.google")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {sq.POSTS}
SELECT * FROM (SELECT id, favorite_count, retweet_count, followers, statuses, unnest(urls) AS url FROM posts WHERE lang = 'en')
WHERE url LIKE '%play.google%'
""")
def english_url_posts(spark, sf_dir):
    exploded = tb.posts(spark, sf_dir).where("lang = 'en'").select(
        "id", F.col("favoriteCount").alias("favorite_count"),
        F.col("retweetCount").alias("retweet_count"), F.col("user.followersCount").alias("followers"),
        F.col("user.statusesCount").alias("statuses"),
        F.explode("urlEntities.expandedURL").alias("url"))
    return exploded.where(F.col("url").like("%play.google%"))


@query(f"""
WITH {sq.STORE_LINKS}
SELECT app_id, post_id, length(d.text) AS n_chars FROM store_links JOIN documents d ON d.doc_id = post_id
WHERE d.lang = 'en'
""")
def english_store_links(spark, sf_dir):
    """The same selection as SQL text over a view: matching URLs of English posts by app."""
    tb.posts(spark, sf_dir).createOrReplaceTempView("posts_view")
    rows = spark.sql("""
        SELECT id, text, filter(urlEntities.expandedURL, u -> contains(u, 'play.google')) AS urls
        FROM posts_view WHERE lang = 'en'""")
    exploded = rows.where(F.size("urls") > 0).select("id", "text", F.explode("urls").alias("url"))
    return exploded.select(ids.app_id_from_url(F.col("url")).alias("app_id"),
                           F.col("id").alias("post_id"),
                           F.length("text").cast("long").alias("n_chars"))


@query(f"""
WITH {sq.STORE_LINKS}
SELECT app_id, count(*) AS n_pairs, (SELECT count(*) FROM posts) AS n_posts FROM store_links GROUP BY app_id
""")
def url_app_pairs(spark, sf_dir):
    """(text, app) pairs per app next to the number of all posts."""
    n_posts = tb.posts(spark, sf_dir).count()
    return _store_links(spark, sf_dir).groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_pairs")).withColumn("n_posts", F.lit(n_posts).cast("long"))


def _store_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.posts(spark, sf_dir).select(
        F.col("id").alias("post_id"), "text",
        F.explode(F.filter("urlEntities.expandedURL", lambda u: u.contains("play.google"))).alias("url"))
    return rows.select("post_id", "text", ids.app_id_from_url(F.col("url")).alias("app_id"))


@query(f"WITH {sq.POSTS} SELECT url, count(*) AS n FROM (SELECT unnest(urls) AS url FROM posts) GROUP BY url")
def flattened_urls(spark, sf_dir):
    urls = tb.posts(spark, sf_dir).select(F.explode("urlEntities.expandedURL").alias("url"))
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
SELECT page_id, {sq.app_id('url')} AS app_id,
       nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_parameter FROM pages
""")
def url_app_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", ids.app_id_from_url(F.col("url")).alias("app_id"),
        F.nullif(ids.app_id_from_query(F.col("url"), "page"), F.lit("")).alias("page_parameter"))


@query(f"WITH {tb.FEATURES_SQL} SELECT apk, split_part(apk, '-', 1) AS app_id FROM features")
def apk_app_ids(spark, sf_dir):
    return tb.feature_table(spark, sf_dir).select(
        "apk", ids.app_id_from_apk(F.col("apk")).alias("app_id"))


@query(f"WITH {sq.POSTS} SELECT id, {sq.app_id('urls[1]')} AS app_id FROM posts WHERE len(urls) > 0")
def entity_app_ids(spark, sf_dir):
    """App id of each post's first URL, read from the typed entity."""
    return tb.posts(spark, sf_dir).where(F.size("urlEntities") > 0).select(
        "id", ids.app_id_from_entities(F.col("urlEntities")).alias("app_id"))


@query(f"WITH {sq.POSTS} SELECT id, followers, friends, favourites, statuses, n_media, len(urls) AS n_urls, reply_to > -1 AS is_reply FROM posts WHERE id IN (SELECT doc_id FROM labels)")
def post_metrics(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return features.metrics_for_ids(tb.posts(spark, sf_dir), wanted)


@query(f"""
WITH {sq.POSTS}
SELECT id, CAST(followers AS DOUBLE) AS v0, CAST(n_media AS DOUBLE) AS v4,
       CASE WHEN reply_to > -1 THEN 1.0 ELSE 0.0 END AS v6, 7 AS width FROM posts
""")
def numeric_post_vectors(spark, sf_dir):
    """Post metrics as one numeric vector; booleans become 0 or 1."""
    rows = features.post_metrics(tb.posts(spark, sf_dir))
    vectors = rows.select("id", labels.numeric_array(rows).alias("v"))
    return vectors.select("id", F.col("v")[0].alias("v0"), F.col("v")[4].alias("v4"),
                          F.col("v")[6].alias("v6"), F.size("v").alias("width"))


# ---------------------------------------------------------------- keyword and app files

@query(f"""
WITH {tb.KEYWORD_ROWS_SQL}
SELECT kind, phrase, count(*) AS n FROM (SELECT kind, unnest(fields) AS phrase FROM keyword_rows) GROUP BY kind, phrase
""")
def keyword_file_phrases(spark, sf_dir):
    benign = tb.stored_lines(tb.benign_lines(spark, sf_dir), F.col("value"), "benign")
    malware = tb.stored_lines(tb.malware_lines(spark, sf_dir), F.col("value"), "malware")
    rows = readers.read_keywords(spark, benign, malware)
    return rows.select("kind", F.explode("fields").alias("phrase")).groupBy("kind", "phrase").agg(
        F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(item_id AS VARCHAR) AS app_id, replace(text, chr(10), ' ') AS text FROM benchmark")
def app_text_lines(spark, sf_dir):
    path = tb.stored_lines(tb.app_parts(spark, sf_dir), F.col("value"), "app-texts")
    return readers.read_app_texts(spark, path).select(
        "app_id", F.array_join(F.slice("parts", F.lit(2), F.size("parts")), " " * 8).alias("text"))


@query(r"SELECT CAST(page_id AS VARCHAR) AS app_id, regexp_replace(regexp_replace(html, '[\n\r]', ' ', 'g'), '<[^>]*>', '', 'g') AS description FROM pages")
def description_lines(spark, sf_dir):
    line = F.concat_ws(",", F.col("page_id").cast("string"),
                       F.regexp_replace("html", r"[\n\r]", " "))
    return readers.read_descriptions(
        spark, tb.stored_lines(table(spark, sf_dir, "pages"), line, "descriptions"))


@query("""
SELECT p_partkey, p_name, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
ON l_partkey = p_partkey
""")
def count_lookup(spark, sf_dir):
    """A two-column CSV lookup joined, instead of a map on the driver."""
    path = scratch_path(spark, "counts")
    table(spark, sf_dir, "lineitem").groupBy("l_partkey").count().write.csv(path)
    counts = readers.read_lookup(spark, path, "p_partkey BIGINT, n BIGINT")
    return joins.lookup_join(table(spark, sf_dir, "part").select("p_partkey", "p_name"),
                             counts, "p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 25 AND p_type = 'ECONOMY'")
def table_scan(spark, sf_dir):
    """Filter and columns reach the scan through the same interface a JDBC url uses."""
    return readers.read_table(spark, sf_dir, "part").where(
        "p_size >= 25 AND p_type = 'ECONOMY'").select("p_partkey", "p_size")


@query(f"""
WITH {tb.FEATURES_SQL}
SELECT apk[1:-5] AS apk, 4 AS width, CAST(f_size AS DOUBLE) AS first, CAST(f_brand AS DOUBLE) AS last FROM features
""")
def feature_file_rows(spark, sf_dir):
    rows = tb.feature_table(spark, sf_dir)
    columns = [F.col(c).cast("string") for c in rows.columns[4:]]
    line = F.concat_ws(",", F.concat(F.lit("/store/apks/"), "apk"), *columns)
    header = rows.agg(F.count(F.lit(1))).select(F.lit("apk,f_size,f_name,f_type,f_brand").alias("value"))
    path = tb.stored_lines(rows.select(line.alias("value")).unionByName(header), F.col("value"),
                           "features")
    parsed = readers.read_feature_lines(spark, path)
    return parsed.select("apk", F.size("features").alias("width"), F.col("features")[0].alias("first"),
                         F.element_at("features", -1).alias("last"))


# ---------------------------------------------------------------- catalogue

def _catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "catalogue")
    tb.catalogue(spark, sf_dir).write.csv(path, header=True)
    return readers.read_catalogue(spark, path)


@query(f"WITH {tb.CATALOGUE_SQL} SELECT sha256, md5 FROM catalogue WHERE markets = 'play.google.com' AND year = '1998'")
def catalogue_market_year(spark, sf_dir):
    return readers.market_year(_catalogue_file(spark, sf_dir), year="1998")


@query(f"WITH {tb.CATALOGUE_SQL} SELECT sha256, detections AS count FROM catalogue")
def catalogue_detections(spark, sf_dir):
    return readers.detections(_catalogue_file(spark, sf_dir))


@query(f"""
WITH {tb.CATALOGUE_SQL}, {tb.SEEN_SQL}
SELECT sha256, md5 FROM catalogue WHERE markets = 'play.google.com'
  AND sha256 NOT IN (SELECT sha256 FROM seen_sha) AND md5 NOT IN (SELECT md5 FROM seen_md5)
""")
def catalogue_minus_seen(spark, sf_dir):
    rows = tb.catalogue(spark, sf_dir).where("markets = 'play.google.com'").select("sha256", "md5")
    return joins.minus_seen(rows, tb.seen_apps(spark, sf_dir)).select("sha256", "md5")


@query(f"""
WITH {tb.CATALOGUE_SQL}, {tb.SEEN_SQL}
SELECT 'sha256' AS seen_by, count(*) AS n FROM catalogue WHERE sha256 IN (SELECT sha256 FROM seen_sha)
UNION ALL SELECT 'md5', count(*) FROM catalogue WHERE md5 IN (SELECT md5 FROM seen_md5)
""")
def catalogue_seen_counts(spark, sf_dir):
    rows = tb.catalogue(spark, sf_dir).select("sha256", "md5")
    return joins.seen_counts(rows, tb.seen_apps(spark, sf_dir))


# ---------------------------------------------------------------- scan reports

def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per part: engines with verdicts; large parts have a damaged report."""
    parts = table(spark, sf_dir, "part")
    verdict = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    engines = F.to_json(F.create_map(
        F.lit("one"), F.col("p_name"), F.lit("two"), verdict,
        F.lit("three"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))))
    body = F.concat(F.lit('{"report": ["2016", '), engines, F.lit("]}"))
    damaged = F.when(F.col("p_size") >= 45, F.substring(body, 1, 30)).otherwise(body)
    return parts.select(F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("md5"),
                        damaged.alias("body"), "p_size")


@query(f"""
WITH {tb.APP_IDS_SQL}
SELECT app_id, md5, 1 + CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS count
FROM part JOIN app_ids ON md5 = md5(CAST(p_partkey AS VARCHAR)) WHERE p_size < 45
""")
def scan_reports(spark, sf_dir):
    return readers.parse_scans_v1(_reports(spark, sf_dir), tb.app_ids(spark, sf_dir))


@query("""
SELECT 'com.p' || p_partkey AS name, p_name AS resource, CAST(floor(p_retailprice / 100) AS INTEGER) AS count
FROM part WHERE p_size < 45
""")
def scan_reports_with_totals(spark, sf_dir):
    positives = F.floor(F.col("p_retailprice") / 100) + 0.5
    body = F.to_json(F.struct(F.col("p_name").alias("resource"), positives.alias("positives")))
    damaged = F.when(F.col("p_size") >= 45, F.substring(body, 1, 12)).otherwise(body)
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("com.p"), F.col("p_partkey").cast("string")).alias("name"),
        damaged.alias("body"))
    return readers.parse_scans_v2(rows)


@query("SELECT md5(CAST(p_partkey AS VARCHAR)) AS md5, 'com.p' || p_partkey AS app_id FROM part")
def store_metadata(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    key = F.col("p_partkey").cast("string")
    apk = F.struct(F.md5(key.cast("binary")).alias("md5sum"),
                   F.concat(F.lit("com.p"), key).alias("package"), F.col("p_type").alias("kind"))
    # a file holds one JSON array over several lines, which only a multi-line reader takes
    parts = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 500).alias("file"),
        F.to_json(F.struct(apk.alias("apk"))).alias("json"))
    files = parts.groupBy("file").agg(F.collect_list("json").alias("all"))
    line = F.concat(F.lit("[\n"), F.array_join("all", ",\n"), F.lit("\n]"))
    files.select("file", line.alias("value")).write.partitionBy("file").text(path)
    return readers.read_store_metadata(spark, path)


@query(f"WITH {tb.CHANGES_SQL} SELECT md5, old, new FROM changes")
def tuple_lines(spark, sf_dir):
    rows = tb.scan_changes(spark, sf_dir)
    line = F.concat(F.lit("("), "md5", F.lit(","), F.col("old").cast("string"), F.lit(","),
                    F.col("new").cast("string"), F.lit(")"))
    return readers.read_tuples(spark, tb.stored_lines(rows, line, "tuples"),
                               "md5 STRING, old INT, new INT")


@query(f"""
WITH {tb.CHANGES_SQL}
SELECT count(*) AS considered, count(*) FILTER (old <> new) AS changed, count(*) FILTER (old > new) AS downgraded,
       count(*) FILTER (old < new) AS upgraded, count(*) FILTER (old = 0 AND new >= 10) AS clean_to_flagged,
       count(*) FILTER (old >= 10 AND new = 0) AS flagged_to_clean FROM changes
""")
def scan_change_counters(spark, sf_dir):
    return labels.scan_change_counters(tb.scan_changes(spark, sf_dir))


@query(f"WITH {tb.CHANGES_SQL} SELECT md5, old, new FROM changes WHERE md5 IN (SELECT md5(CAST(l_partkey AS VARCHAR)) FROM lineitem)")
def joined_scans(spark, sf_dir):
    changes = tb.scan_changes(spark, sf_dir)
    app_ids = tb.app_ids(spark, sf_dir)
    old = joins.lookup_join(changes.select("md5", "old"), app_ids, "md5").select("app_id", "old")
    return labels.joined_scans(app_ids, old, changes.select("md5", "new"))


# ---------------------------------------------------------------- labels and feature rows

def _threshold_sql(t: int) -> str:
    return (f"SELECT {t} AS threshold, apk, CASE WHEN scanners >= {t} THEN 1.0 ELSE 0.0 END AS label "
            f"FROM features WHERE scanners >= {t} OR scanners = 0")


@query(f"WITH {tb.FEATURES_SQL} " + " UNION ALL ".join(_threshold_sql(t) for t in (3, 5, 10)))
def labels_from_counts(spark, sf_dir):
    """Labels at the three detection thresholds in use; undecided and unscanned apps drop."""
    rows = tb.feature_table(spark, sf_dir).select("apk", "scannersCount")
    parts = [
        labels.with_labels(rows, "scannersCount", t).select(
            F.lit(t).alias("threshold"), "apk", "label") for t in (3, 5, 10)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {tb.FEATURES_SQL} SELECT apk, 4 AS width, CAST(f_size + f_name + f_type + f_brand AS DOUBLE) AS total FROM features")
def feature_slice(spark, sf_dir):
    """Columns after the four leading ones as one dense vector."""
    rows = tb.feature_table(spark, sf_dir)
    vectors = rows.select("apk", labels.feature_array(rows, 4).alias("v"))
    return vectors.select("apk", F.size("v").alias("width"),
                          F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


LABELLED_SQL = f"""
{tb.FEATURES_SQL}, {tb.APP_IDS_SQL},
labelled AS (SELECT app_id, CASE WHEN scanners >= 3 THEN 1.0 ELSE 0.0 END AS label,
                    f_size, f_name, f_type, f_brand, p_partkey
             FROM features JOIN app_ids USING (md5) WHERE scanners >= 3 OR scanners = 0)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.feature_table(spark, sf_dir)
    return labels.labelled_features(rows, tb.app_ids(spark, sf_dir), "md5", "app_id",
                                    "scannersCount", 3, rows.columns[4:])


@query(f"WITH {LABELLED_SQL} SELECT app_id, label, CAST(f_size AS DOUBLE) AS f_size, 4 AS width FROM labelled")
def labelled_features(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "app_id", "label", F.col("features")[0].alias("f_size"), F.size("features").alias("width"))


@query(f"WITH {LABELLED_SQL} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def class_balance(spark, sf_dir):
    return metrics.class_balance(_labelled(spark, sf_dir))


def _order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts about the app numbered like their customer: (post_id, app_id, vector)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"),
        F.concat(F.lit("com.p"), F.col("o_custkey").cast("string")).alias("app_id"),
        F.array(F.col("o_totalprice"), F.length("o_orderpriority").cast("double"),
                F.month("o_orderdate").cast("double")).alias("vector"))


ORDER_VECTORS_SQL = """
ov AS (SELECT o_orderkey AS post_id, 'com.p' || o_custkey AS app_id, o_totalprice AS v0,
              CAST(length(o_orderpriority) AS DOUBLE) AS v1, CAST(month(o_orderdate) AS DOUBLE) AS v2,
              o_custkey FROM orders)
"""


@query(f"""
WITH {LABELLED_SQL}, {ORDER_VECTORS_SQL}
SELECT post_id, app_id, label, v0, 7 AS width FROM ov JOIN labelled USING (app_id)
""")
def labelled_vectors_join(spark, sf_dir):
    """Post vectors joined to their app's labelled row; a hot app is split over tasks."""
    joined = joins.lookup_join(_order_vectors(spark, sf_dir), _labelled(spark, sf_dir), "app_id")
    both = features.combined(F.col("features"), F.col("vector"))
    return joined.select("post_id", "app_id", "label", F.col("vector")[0].alias("v0"),
                         F.size(both).alias("width"))


def _reduced(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    reduced = features.reduce_vectors(_order_vectors(spark, sf_dir), method)
    v = F.col("vector")
    return reduced.select("app_id", *[F.round(v[i], 6).alias(f"v{i}") for i in range(3)],
                          v[3].alias("n"))


def _reduced_sql(aggregate: str) -> str:
    cells = ", ".join(f"round({aggregate.format(v=f'v{i}')}, 6) AS v{i}" for i in range(3))
    return f"WITH {ORDER_VECTORS_SQL} SELECT app_id, {cells}, CAST(count(*) AS DOUBLE) AS n FROM ov GROUP BY app_id"


@query(_reduced_sql("avg({v})"))
def reduced_average(spark, sf_dir):
    return _reduced(spark, sf_dir, "average")


@query(_reduced_sql("sum({v})"))
def reduced_sum(spark, sf_dir):
    return _reduced(spark, sf_dir, "sum")


@query(_reduced_sql("median({v})"))
def reduced_median(spark, sf_dir):
    return _reduced(spark, sf_dir, "median")


@query(_reduced_sql("arg_min({v}, post_id)"))
def reduced_head(spark, sf_dir):
    """The vector of each app's first post by id."""
    return _reduced(spark, sf_dir, "head")


@query(f"""
WITH {LABELLED_SQL}, {ORDER_VECTORS_SQL}
SELECT app_id, label, round(avg(v0), 6) AS mean0, CAST(count(*) AS DOUBLE) AS n, 8 AS width
FROM ov JOIN labelled USING (app_id) GROUP BY app_id, label
""")
def linked_features(spark, sf_dir):
    """App features next to the average of the linked posts' vectors and their number."""
    vectors = _order_vectors(spark, sf_dir)
    joint = features.linked_features(vectors.select("post_id", "app_id"),
                                     vectors.select("post_id", "vector"), _labelled(spark, sf_dir))
    return joint.select("app_id", "label", F.round(F.col("joint")[4], 6).alias("mean0"),
                        F.element_at("joint", -1).alias("n"), F.size("joint").alias("width"))


@query(f"""
WITH {LABELLED_SQL}, {ORDER_VECTORS_SQL}
SELECT post_id, e.app_id AS estimated_item_id, e.label, t.label AS real_label, v0
FROM ov JOIN labelled e ON e.app_id = 'com.p' || (o_custkey + 1) LEFT JOIN labelled t ON t.app_id = ov.app_id
""")
def mislinked_rows(spark, sf_dir):
    """Posts attributed to the neighbouring app: its features, next to the true app's label."""
    return mislinked(spark, sf_dir).select(
        "post_id", "estimated_item_id", "label", "real_label", F.col("vector")[0].alias("v0"))


def mislinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"),
        F.concat(F.lit("com.p"), (F.col("o_custkey") + 1).cast("string")).alias("estimated_item_id"))
    vectors = _order_vectors(spark, sf_dir).withColumnRenamed("app_id", "true_item_id")
    return labels.mislinked_rows(vectors.join(customer, "post_id"), _labelled(spark, sf_dir))


@query(f"""
WITH {sq.STORE_LINKS},
counts AS (SELECT 'com.' || source AS app_id, sum(toxic) AS count FROM labels JOIN documents USING (doc_id) GROUP BY source),
apps AS (SELECT DISTINCT app_id FROM store_links)
SELECT count(*) AS linked_apps, count(*) FILTER (count = 0) AS benign_apps, count(*) FILTER (count >= 3) AS malware_apps,
       count(*) FILTER (count = 0 OR count >= 3) AS labelled_apps FROM apps LEFT JOIN counts USING (app_id)
""")
def apps_per_class(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = joined.groupBy(F.concat(F.lit("com."), "source").alias("app_id")).agg(
        F.sum("toxic").alias("count"))
    return labels.apps_per_class(_store_links(spark, sf_dir), counts)


@query(f"""
WITH {sq.STORE_LINKS}, {SENTIMENT_SQL}
SELECT app_id, round(avg(score), 6) AS mean, count(*) AS n FROM store_links JOIN scores ON doc_id = post_id GROUP BY app_id
""")
def mean_sentiment_per_app(spark, sf_dir):
    links = landed(_store_links(spark, sf_dir).select("app_id", "post_id", "text"), "links")
    # a post of several links is scored once
    means = sentiment_means(links.select("post_id", "text").distinct(),
                            derived_lexicon(spark, sf_dir), "post_id")
    scored = links.join(means, "post_id").select("app_id", sentiment_score(F.col("m")).alias("score"))
    return features.mean_per_app(scored).withColumn("mean", F.round("mean", 6))


# ---------------------------------------------------------------- membership and sets

@query("""
SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer
""")
def app_existence(spark, sf_dir):
    """Which of many ids a table holds: one join, not one job per id."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return joins.exists_in(wanted, orders, "id")


@query(f"""
WITH {tb.FEATURES_SQL}, {tb.CHANGES_SQL}
SELECT apk, f.md5, new FROM features f JOIN changes c ON c.md5 = f.md5
""")
def scanned_feature_overlap(spark, sf_dir):
    """Apps with both a feature row and a scan result."""
    rows = tb.feature_table(spark, sf_dir).select("apk", "md5")
    return joins.lookup_join(rows, tb.scan_changes(spark, sf_dir).select("md5", "new"), "md5")


@query("SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return docs.intersect(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return joins.lookup_join(docs, known, "id", "left_anti")


@query("SELECT 'document' AS kind, doc_id AS id, length(text) AS n_chars FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark")
def text_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    return docs.unionByName(items).select("kind", "id", F.length("text").cast("long").alias("n_chars"))


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS number FROM customer")
def key_numbers(spark, sf_dir):
    """Dense int ids for string keys, as factorisation needs them."""
    return numbered_keys(table(spark, sf_dir, "customer"), "c_name", "number").withColumn(
        "number", F.col("number").cast("long"))


# ---------------------------------------------------------------- sinks

@query("SELECT url AS value FROM pages")
def text_sink(spark, sf_dir):
    """One column written as text over four files and read back."""
    path = scratch_path(spark, "text-sink")
    sinks.write_lines(table(spark, sf_dir, "pages"), path, F.col("url"), files=4)
    return spark.read.text(path)


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_sink(spark, sf_dir):
    path = scratch_path(spark, "json-sink")
    sinks.write_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return spark.read.schema("doc_id BIGINT, lang STRING, n_chars BIGINT").json(path)


@query("SELECT 'com.' || source AS key, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def keyed_text_sink(spark, sf_dir):
    path = scratch_path(spark, "keyed-sink")
    rows = table(spark, sf_dir, "documents").withColumn("app_id", F.concat(F.lit("com."), "source"))
    sinks.write_keyed_text(rows, path, "app_id", "text")
    return readers.read_cache(spark, path).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {LABELLED_SQL} SELECT app_id, label FROM labelled")
def cache_round_trip(spark, sf_dir):
    """Labelled rows materialised and reloaded."""
    return sinks.write_cache(_labelled(spark, sf_dir), scratch_path(spark, "cache")).select(
        "app_id", "label")


@query("""
SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey
""")
def insert_ignore_rows(spark, sf_dir):
    """Rows an insert-ignore would add: unseen keys only, one row each."""
    new = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("custkey"))
    return joins.insert_ignore(new, known, "custkey")
