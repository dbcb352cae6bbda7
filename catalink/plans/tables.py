"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalink.functions.text import ngrams
from catalink.operators.vectorize import TermModel, fit_terms, with_terms
from catalink.session import landed, scratch_path, spread
from catalink.sources import readers
from catalink.sources.readers import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def stored_lines(df: DataFrame, line: Column, label: str) -> str:
    """Write derived text lines to the shared folder and return their path."""
    path = scratch_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: the page of the same number and, for labelled documents, a store
    link are their URLs."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    joined = docs.join(pages, "doc_id", "left").join(labels, "doc_id", "left")
    none = F.array().cast("array<string>")
    store = F.concat(F.lit("https://play.google.com/store/apps/details?id=com."), "source",
                     F.lit("&hl="), "lang")
    urls = F.concat(F.when(F.col("url").isNotNull(), F.array("url")).otherwise(none),
                    F.when(F.col("known"), F.array(store)).otherwise(none))
    reply = F.coalesce(F.col("quality") + 10 * F.col("toxic"), F.lit(-1)).cast("long")
    media = F.when(F.col("toxic") == 1, F.array(F.struct(F.col("source").alias("mediaURL"))))
    return joined.select(
        F.col("doc_id").alias("id"), "text", "lang", reply.alias("inReplyToUserId"),
        F.col("n_chars").alias("favoriteCount"),
        F.coalesce("toxic", F.lit(0)).cast("long").alias("retweetCount"),
        F.transform(urls, lambda u: F.struct(u.alias("expandedURL"))).alias("urlEntities"),
        F.coalesce(media, F.array().cast("array<struct<mediaURL: string>>")).alias("mediaEntities"),
        F.struct(
            F.col("n_chars").alias("followersCount"),
            F.length("source").cast("long").alias("friendsCount"),
            F.coalesce("quality", F.lit(0)).cast("long").alias("favouritesCount"),
            F.length("lang").cast("long").alias("statusesCount"),
            F.col("source").alias("createdAt")).alias("user"))


def stored_posts(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "posts")
    posts(spark, sf_dir).write.json(path)
    return path


def benign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lines with tabs: all words of an item, three by three, and its package."""
    words = F.split(F.regexp_replace("text", r"[\t\n]", " "), " ")
    threes = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 3).cast("int")),
        lambda i: F.array_join(F.slice(words, 3 * i + 1, 3), " "))
    line = F.concat_ws("\t", threes,
                       F.concat(F.lit("com.item"), F.col("item_id").cast("string")))
    return table(spark, sf_dir, "benchmark").select(line.alias("value"))


def malware_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parenthesised keyword lines: file, package, title; some titles are not found."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    title = F.when(F.col("p_size") > 40, "unfound").otherwise(F.col("p_name"))
    line = F.concat(F.lit("("), key, F.lit(".apk,com.p"), key, F.lit(","), title, F.lit(")"))
    return parts.select(line.alias("value"))


MALWARE_SQL = """
SELECT ['com.p' || p_partkey, CASE WHEN p_size > 40 THEN 'unfound' ELSE p_name END] AS fields FROM part
"""
BENIGN_SQL = r"""
SELECT list_append([array_to_string(t[3 * i + 1:3 * i + 3], ' ') FOR i IN range(0, (len(t) + 2) // 3)],
                   'com.item' || item_id) AS fields
FROM (SELECT item_id, string_split(regexp_replace(text, '[\t\n]', ' ', 'g'), ' ') AS t FROM benchmark)
"""
KEYWORD_ROWS_SQL = f"""
keyword_rows AS (SELECT 'benign' AS kind, fields FROM ({BENIGN_SQL}) UNION ALL
                 SELECT 'malware' AS kind, fields FROM ({MALWARE_SQL}))
"""


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.keyword_rows(benign_lines(spark, sf_dir), malware_lines(spark, sf_dir))


def app_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App texts: the item number and its text, eight blanks apart."""
    text = F.regexp_replace("text", r"\n", " ")
    return table(spark, sf_dir, "benchmark").select(
        F.concat_ws(" " * 8, F.col("item_id").cast("string"), text).alias("value"))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App features with four leading columns: apk, class, scannersCount, md5."""
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("com.p"), key, F.lit("-"), F.col("p_size").cast("string"),
                 F.lit(".apk")).alias("apk"),
        F.col("p_type").alias("class"),
        (F.pmod(F.col("p_size"), F.lit(14)) - 1).alias("scannersCount"),
        F.md5(key.cast("binary")).alias("md5"),
        F.col("p_size").alias("f_size"),
        F.length("p_name").alias("f_name"),
        F.length("p_type").alias("f_type"),
        (F.length("p_brand") - 6).alias("f_brand"))


FEATURES_SQL = """
features AS (
  SELECT 'com.p' || p_partkey || '-' || p_size || '.apk' AS apk, p_type AS class,
         p_size % 14 - 1 AS scanners, md5(CAST(p_partkey AS VARCHAR)) AS md5,
         p_size AS f_size, length(p_name) AS f_name, length(p_type) AS f_type,
         length(p_brand) - 6 AS f_brand, p_partkey
  FROM part)
"""


def app_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md5 to app id for the apps that were ordered at least once."""
    ordered = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    key = F.col("l_partkey").cast("string")
    return ordered.select(F.md5(key.cast("binary")).alias("md5"),
                          F.concat(F.lit("com.p"), key).alias("app_id"))


APP_IDS_SQL = """
app_ids AS (SELECT DISTINCT md5(CAST(l_partkey AS VARCHAR)) AS md5, 'com.p' || l_partkey AS app_id
            FROM lineitem)
"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an app catalogue of eleven fields."""
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    market = (F.when(F.col("o_orderpriority") == "1-URGENT", "play.google.com")
              .when(F.col("o_orderpriority") == "2-HIGH", "play.google.com|anzhi")
              .otherwise("appchina"))
    found = F.when(F.col("o_orderstatus") != "O",
                   F.pmod("o_custkey", F.lit(13)).cast("string")).otherwise("")
    built = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), order).alias("sha256"), F.concat(F.lit("h"), order).alias("sha1"),
        F.concat(F.lit("m"), customer).alias("md5"), built.alias("dex_date"),
        F.floor("o_totalprice").alias("apk_size"),
        F.concat(F.lit("com.c"), customer).alias("pkg_name"),
        F.col("o_orderpriority").alias("vercode"), found.alias("vt_detection"),
        built.alias("vt_scan_date"), F.col("o_custkey").alias("dex_size"),
        market.alias("markets"))


CATALOGUE_SQL = """
catalogue AS (
  SELECT 's' || o_orderkey AS sha256, 'm' || o_custkey AS md5,
         strftime(o_orderdate, '%Y') AS year,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 13 AS INTEGER) ELSE -1 END AS detections,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'play.google.com'
              WHEN '2-HIGH' THEN 'play.google.com|anzhi' ELSE 'appchina' END AS markets
  FROM orders)
"""


def seen_apps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Already fetched apps: returned orders by sha256, indebted customers by md5."""
    lines, customers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    return {
        "sha256": lines.where("l_returnflag = 'R'").select(
            F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("sha256")),
        "md5": customers.where("c_acctbal < 0").select(
            F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("md5")),
    }


SEEN_SQL = """
seen_sha AS (SELECT DISTINCT 's' || l_orderkey AS sha256 FROM lineitem WHERE l_returnflag = 'R'),
seen_md5 AS (SELECT 'm' || c_custkey AS md5 FROM customer WHERE c_acctbal < 0)
"""


def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(md5, old, new): a part's size-based count and its number of returned lines."""
    returned = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("new"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.pmod("p_size", F.lit(14)).alias("old"))
    return parts.join(returned, "l_partkey").select(
        F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("md5"), "old", "new")


CHANGES_SQL = """
changes AS (SELECT md5(CAST(p_partkey AS VARCHAR)) AS md5, p_size % 14 AS old,
                   CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS new
            FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size)
"""


# ---------------------------------------------------------------- linking corpora

def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, spread over the cores when the scan has few partitions."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "post_id")


def talk_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(posts, items) of the ground truth: a conversation's first turn is its item."""
    turns = spread(table(spark, sf_dir, "conversations"))
    items = turns.where("turn = 0").select(F.col("conv_id").alias("item_id"), "text")
    later = turns.where("turn > 0").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"),
        F.col("conv_id").alias("true_item_id"), "text")
    return later, items


def term_corpus(post_rows: DataFrame, item_rows: DataFrame, n: int = 1, min_df: int = 1,
                stem: bool = False, form: str = "tfidf", in_buckets: bool = False,
                ) -> tuple[DataFrame, DataFrame, TermModel]:
    """(posts, items, model) with terms in place of texts; the model is fitted on both sides.

    The texts are cleaned once: the words are written, and every later pass makes its terms of them,
    because runs of n words take n times the room.
    """
    posts_t, items_t = (
        landed(with_terms(rows, stem=stem), label).withColumn("terms", ngrams(F.col("terms"), n))
        for rows, label in ((post_rows, "post-words"), (item_rows, "item-words")))
    both = posts_t.select("terms").unionAll(items_t.select("terms"))
    return posts_t, items_t, fit_terms(both, form=form, min_df=min_df, in_buckets=in_buckets)
