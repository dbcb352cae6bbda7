"""Explicit schemas of the inputs; nothing is inferred from data."""

POST = (
    "id BIGINT, text STRING, lang STRING, inReplyToUserId BIGINT, favoriteCount BIGINT, "
    "retweetCount BIGINT, urlEntities ARRAY<STRUCT<expandedURL: STRING>>, "
    "mediaEntities ARRAY<STRUCT<mediaURL: STRING>>, "
    "user STRUCT<followersCount: BIGINT, friendsCount: BIGINT, favouritesCount: BIGINT, "
    "statusesCount: BIGINT, createdAt: STRING>"
)
CATALOGUE = (
    "sha256 STRING, sha1 STRING, md5 STRING, dex_date STRING, apk_size BIGINT, pkg_name STRING, "
    "vercode STRING, vt_detection STRING, vt_scan_date STRING, dex_size BIGINT, markets STRING"
)
STORE_METADATA = "apk STRUCT<md5sum: STRING, package: STRING>"
SCAN_V1 = "report ARRAY<STRING>"
SCAN_V2 = "resource STRING, positives DOUBLE"
EVENT = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
