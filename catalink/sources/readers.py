"""File and table readers. Each line format has a parser over a ``value`` column and a
reader that applies it to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalink import schemas
from catalink.functions.ids import base_name
from catalink.functions.text import strip_tags

APP_TEXT_GAP = " " * 8


# ---------------------------------------------------------------- posts

def read_posts(spark: SparkSession, path: str, fraction: float | None = None,
               seed: int = 11) -> DataFrame:
    """JSON posts with an explicit schema, optionally sampled."""
    posts = spark.read.schema(schemas.POST).json(path)
    return posts if fraction is None else posts.sample(False, fraction, seed)


def parse_post_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """One column ``post`` per line; null, with the raw line kept, when it does not parse."""
    parsed = F.from_json(
        F.col(value), schemas.POST + ", _bad STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.col(value).alias("raw"), parsed.alias("post")).withColumn(
        "ok", F.col("post").isNotNull() & F.col("post._bad").isNull() & F.col("post.id").isNotNull())


def read_post_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, rejects): well-formed posts, and the raw lines that are none."""
    parsed = parse_post_lines(spark.read.text(path))
    posts = parsed.where("ok").select("post.*").drop("_bad")
    return posts, parsed.where("not ok").select("raw")


# ---------------------------------------------------------------- keyword files

def parse_tab_fields(value: Column) -> Column:
    """Fields of a benign keyword line: title, creator, package."""
    return F.split(value, "\t")


def parse_tuple_fields(value: Column) -> Column:
    """Fields of a parenthesised line without the first (the file name)."""
    fields = F.split(F.substring(value, F.lit(2), F.length(value) - 2), ",")
    return F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))


def keyword_rows(benign: DataFrame, malware: DataFrame, value: str = "value") -> DataFrame:
    """(kind, fields) of both keyword files."""
    return benign.select(
        F.lit("benign").alias("kind"), parse_tab_fields(F.col(value)).alias("fields")
    ).unionByName(malware.select(
        F.lit("malware").alias("kind"), parse_tuple_fields(F.col(value)).alias("fields")))


def read_keywords(spark: SparkSession, benign_path: str, malware_path: str) -> DataFrame:
    return keyword_rows(spark.read.text(benign_path), spark.read.text(malware_path))


# ---------------------------------------------------------------- app texts

def parse_app_text(value: Column) -> Column:
    """Parts of an app text line, separated by eight blanks."""
    return F.split(value, APP_TEXT_GAP)


def read_app_texts(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, parts, words) of an app text file; the first part names the app."""
    parts = spark.read.text(path).select(parse_app_text(F.col("value")).alias("parts"))
    return app_words(parts)


def app_words(parts: DataFrame) -> DataFrame:
    words = F.flatten(F.transform("parts", lambda p: F.split(p, " ")))
    return parts.select(F.get("parts", F.lit(0)).alias("app_id"), "parts", words.alias("words"))


def parse_descriptions(lines: DataFrame, value: str = "value") -> DataFrame:
    """(app_id, description): split on the first comma, tags stripped, other lines dropped."""
    parts = F.split(F.col(value), ",", 2)
    return lines.select(parts.alias("p")).where(F.size("p") == 2).select(
        F.col("p")[0].alias("app_id"), strip_tags(F.col("p")[1]).alias("description"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return parse_descriptions(spark.read.text(path))


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A two-column CSV lookup as a table to join, not a driver-side map."""
    return spark.read.schema(schema).csv(path)


# ---------------------------------------------------------------- tables

def read_table(spark: SparkSession, location: str, table: str | None = None, *,
               partition_column: str | None = None, bounds: tuple[int, int] | None = None,
               partitions: int | None = None, **options: str) -> DataFrame:
    """A feature table from a JDBC url, or from parquet files at any other location.

    Filters and column selections on the result reach either source. A JDBC scan is split
    over ``partitions`` ranges of ``partition_column`` when they are given.
    """
    if not location.startswith("jdbc:"):
        return spark.read.parquet(location if table is None else f"{location}/{table}.parquet")
    reader = spark.read.format("jdbc").option("url", location).option("dbtable", table)
    if partition_column is not None:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", partitions))
    return reader.options(**options).load()


def parse_feature_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(apk, features) of a feature CSV; header lines are skipped, folders cut off."""
    text = F.col(value)
    header = text.startswith("apk") | text.endswith("ACTION_PACKAGE_RESTARTED")
    fields = F.split(text, ",")
    return lines.where(~header).select(
        base_name(F.get(fields, F.lit(0))).alias("apk"),
        F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda v: v.cast("double"))
        .alias("features"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_feature_lines(spark.read.text(path))


# ---------------------------------------------------------------- catalogue and scans

def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOGUE).csv(path, header=True)


def market_year(catalogue: DataFrame, market: str = "play.google.com", year: str = "2016") -> DataFrame:
    """(sha256, md5) of apps listed by exactly this market and built in this year."""
    built = F.substring_index("dex_date", "-", 1)
    return catalogue.where((F.col("markets") == market) & (built == year)).select("sha256", "md5")


def detections(catalogue: DataFrame) -> DataFrame:
    """(sha256, count): detections of each app, -1 when it was never scanned."""
    count = F.coalesce(F.col("vt_detection").try_cast("int"), F.lit(-1))
    return catalogue.select("sha256", count.alias("count"))


def parse_scans_v1(reports: DataFrame, ids: DataFrame, body: str = "body",
                   md5: str = "md5") -> DataFrame:
    """(app_id, md5, count): engines with a non-empty verdict in the report's second element.

    ``ids`` maps md5 to app. Reports that do not parse or have no second element are skipped.
    """
    report = F.from_json(F.col(body), schemas.SCAN_V1)["report"]
    verdicts = F.from_json(F.get(report, F.lit(1)), "MAP<STRING, STRING>")
    found = reports.select(
        md5, F.size(F.map_filter(verdicts, lambda _, v: v != "")).alias("count"))
    return found.where(F.col("count").isNotNull() & (F.col("count") >= 0)).join(ids, md5).select(
        "app_id", md5, "count")


def parse_scans_v2(reports: DataFrame, body: str = "body", name: str = "name") -> DataFrame:
    """(name, resource, count) of reports that state their number of positives."""
    parsed = F.from_json(F.col(body), schemas.SCAN_V2)
    rows = reports.select(name, parsed.alias("r"))
    return rows.where(F.col("r.resource").isNotNull() & F.col("r.positives").isNotNull()).select(
        name, "r.resource", F.col("r.positives").cast("int").alias("count"))


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """(md5, body): one report per file, named by its md5."""
    return spark.read.text(path, wholetext=True).select(
        base_name(F.col("_metadata.file_name")).alias("md5"), F.col("value").alias("body"))


def read_store_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(md5, app_id) of store metadata files, one JSON object per file."""
    return store_ids(spark.read.schema(schemas.STORE_METADATA).json(path, multiLine=True))


def store_ids(metadata: DataFrame) -> DataFrame:
    return metadata.where("apk IS NOT NULL").select(
        F.col("apk.md5sum").alias("md5"), F.col("apk.package").alias("app_id"))


def parse_tuples(lines: DataFrame, columns: str, value: str = "value") -> DataFrame:
    """Typed columns of parenthesised text tuples, for example ``"md5 STRING, old INT"``."""
    fields = F.split(F.translate(F.col(value), "()", ""), ",")
    names = [part.split() for part in columns.split(",")]
    return lines.select(*[
        F.btrim(F.get(fields, F.lit(i))).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(names)])


def read_tuples(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return parse_tuples(spark.read.text(path), columns)


# ---------------------------------------------------------------- caches and streams

def read_cache(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A materialised intermediate result."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stream_posts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Posts landed as JSON files, as a stream."""
    return (
        spark.readStream.schema(schemas.POST).option("maxFilesPerTrigger", files_per_batch)
        .json(path))


def stream_events(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Events landed as parquet files, as a stream."""
    reader = spark.readStream.schema(schemas.EVENT)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)
