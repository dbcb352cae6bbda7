"""Labels from detection counts, labelled feature rows, scan changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalink.operators.joins import lookup_join


def label_from_count(count: Column, threshold: int) -> Column:
    """1 from ``threshold`` detections on, 0 for none, null (to drop) in between or unknown."""
    return F.when(count >= threshold, 1.0).when(count == 0, 0.0)


def with_labels(rows: DataFrame, count: str, threshold: int) -> DataFrame:
    """Label rows by their detection count and drop the undecided ones."""
    return rows.withColumn("label", label_from_count(F.col(count), threshold)).where(
        F.col("label").isNotNull())


def feature_array(df: DataFrame, skip: int) -> Column:
    """All columns after the first ``skip`` as one dense array."""
    return F.array(*[F.col(c).cast("double") for c in df.columns[skip:]])


def numeric_array(df: DataFrame, skip: int = 1) -> Column:
    """Columns after the first ``skip`` as numbers; booleans become 0 or 1.

    Only booleans, ints and longs are numeric features.
    """
    allowed = {"boolean", "int", "bigint"}
    bad = [name for name, kind in df.dtypes[skip:] if kind not in allowed]
    if bad:
        raise TypeError(f"not a numeric feature: {', '.join(bad)}")
    return feature_array(df, skip)


def labelled_features(table: DataFrame, id_map: DataFrame, key: str, app_key: str, count: str,
                      threshold: int, feature_columns: Sequence[str]) -> DataFrame:
    """(app, label, features) for apps found in ``id_map`` (key -> app); every mapping counts."""
    rows = with_labels(table, count, threshold).select(
        key, "label", F.array(*[F.col(c).cast("double") for c in feature_columns]).alias("features"))
    return lookup_join(rows, id_map.select(key, app_key), key).select(app_key, "label", "features")


def scan_change_counters(changes: DataFrame, old: str = "old", new: str = "new",
                         strong: int = 10) -> DataFrame:
    """One row of counters over (old, new) detection counts, in a single pass."""
    before, after = F.col(old), F.col(new)
    return changes.agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if(before != after).alias("changed"),
        F.count_if(before > after).alias("downgraded"),
        F.count_if(before < after).alias("upgraded"),
        F.count_if((before == 0) & (after >= strong)).alias("clean_to_flagged"),
        F.count_if((before >= strong) & (after == 0)).alias("flagged_to_clean"))


def joined_scans(ids: DataFrame, old: DataFrame, new: DataFrame, app_key: str = "app_id",
                 key: str = "md5") -> DataFrame:
    """(md5, old, new): old counts by app and new counts by md5, for ids known to both."""
    return lookup_join(lookup_join(ids, old, app_key), new, key).select(key, "old", "new")


def apps_per_class(links: DataFrame, counts: DataFrame, app_key: str = "app_id",
                   threshold: int = 3) -> DataFrame:
    """One row: linked apps, and those of them with no or at least ``threshold`` detections."""
    apps = links.groupBy(app_key).agg(F.count(F.lit(1)).alias("n_posts"))
    known = apps.join(counts, app_key, "left")
    clean = F.count_if(F.col("count") == 0)
    flagged = F.count_if(F.col("count") >= threshold)
    return known.agg(
        F.count(F.lit(1)).alias("linked_apps"), clean.alias("benign_apps"),
        flagged.alias("malware_apps"), (clean + flagged).alias("labelled_apps"))


def mislinked_rows(link_vectors: DataFrame, labelled: DataFrame, app_key: str = "app_id") -> DataFrame:
    """Vectors joined to the features of the *estimated* item, keeping the true item's label.

    ``link_vectors`` has (post_id, true_item_id, estimated_item_id, vector); a row whose
    estimate is wrong may carry a ``label`` that differs from its ``real_label``.
    """
    estimated = labelled.select(
        F.col(app_key).alias("estimated_item_id"), "label", "features")
    truth = labelled.select(F.col(app_key).alias("true_item_id"), F.col("label").alias("real_label"))
    joined = lookup_join(link_vectors, estimated, "estimated_item_id")
    return lookup_join(joined, truth, "true_item_id", "left")
