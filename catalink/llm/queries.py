"""Registered queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalink.llm import (bpe, decontaminate, exact_dedup, fill_middle, importance, jaccard_join,
                          language_id, language_model, quality, sharding, substrings,
                          token_counts, token_files)

#: Rank file of the tokenisers.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Vocabulary of the tokenizer whose ids are written to files, and the id that ends a document.
WORDS, END = "word_bpe_49k.json", 1

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"),
                                 _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_join(_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contiguous_shards(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return fill_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_ids(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path(WORDS), END)
    return token_files.digests(token_files.read_documents(files))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"),
                               _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_decontamination, op2_substring_dedup, op3_token_counts, op4_quality, op5_jaccard_join,
    op6_language_model, op7_exact_dedup, op8_prefix_bpe, op9_language_id, op10_minimax_shards,
    op11_fill_middle, op12_token_files, op13_importance)}

_WORDS = r"""
REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""".strip()

SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, LEAST(LEN(w), 10) AS n, w[i:i + LEAST(LEN(w), 10) - 1] AS s
  FROM b, UNNEST(RANGE(1, GREATEST(LEN(w) - 9, 1) + 1)) AS t(i) WHERE LEN(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
found AS (
  SELECT doc_id, i, x.n, item_id FROM (
    SELECT doc_id, i, n, w[i:i + n - 1] AS s
    FROM d, lengths, UNNEST(RANGE(1, LEN(w) - n + 2)) AS t(i)) AS x
  JOIN items ON items.n = x.n AND items.s = x.s),
hits AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found) AS f, UNNEST(RANGE(i, i + n)) AS t(p)
  GROUP BY doc_id),
named AS (
  SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, LEN(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""".strip(),
    "op7_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
       doc_id = MAX(doc_id) OVER g AS kept, SHA256(COALESCE(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY COALESCE(text, ''))
""".strip(),
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text,
                  REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  SHA256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, LEN(u) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN RANGE(4)] AS r FROM d),
c AS (SELECT *, LEAST(r[1] % (n + 1), r[2] % (n + 1)) AS a, GREATEST(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR CONTAINS(text, '<P>') OR CONTAINS(text, '<S>') OR CONTAINS(text, '<M>')
                       OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM n),
p AS (SELECT *, COALESCE(ARRAY_TO_STRING(u[1:a], ''), '') AS prefix,
             COALESCE(ARRAY_TO_STRING(u[a + 1:b], ''), '') AS middle,
             COALESCE(ARRAY_TO_STRING(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN LENGTH(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN LENGTH(middle) END AS middle_chars,
       SHA256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       SHA256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
""".strip(),
    "op13_importance": f"""
WITH steps AS (
  SELECT i, LIST_REDUCE([i, 0, 0, 0, 0, 0, 0, 0, 0],
           LAMBDA c, z: XOR(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS t
  FROM RANGE(256) AS x(i)),
tab AS (SELECT LIST(t ORDER BY i) AS t FROM steps),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(w) AS word FROM d) GROUP BY word),
bw AS (SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(w) AS word FROM b) GROUP BY word),
octets AS (SELECT word, [4294967295] || [CAST('0x' || HEX(word)[2 * i - 1:2 * i] AS BIGINT)
                                         FOR i IN RANGE(1, LEN(HEX(word)) // 2 + 1)] AS o
           FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, XOR(LIST_REDUCE(o, LAMBDA c, x: XOR(c >> 8, t[(XOR(c, x) & 255) + 1])), 4294967295) % 10000 AS k
        FROM octets, tab),
own AS (SELECT k, SUM(n) AS s FROM dw JOIN crc USING (word) GROUP BY k),
aim AS (SELECT k, SUM(n) AS t FROM bw JOIN crc USING (word) GROUP BY k),
total AS (SELECT (SELECT COALESCE(SUM(n), 0) FROM dw) AS s_all, (SELECT COALESCE(SUM(n), 0) FROM bw) AS t_all),
gain AS (SELECT k, CAST(FLOOR(1000 * LN(CAST((COALESCE(t, 0) + 1) * (s_all + 10000) AS DOUBLE)
                              / CAST((COALESCE(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
         FROM own FULL JOIN aim USING (k), total),
weights AS (SELECT doc_id, SUM(g) AS weight FROM (SELECT doc_id, UNNEST(w) AS word FROM d)
            JOIN crc USING (word) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, LEN(w) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
         CAST(COALESCE(weight, 0) AS BIGINT) + CAST(FLOOR(-1000 * LN(-LN(
           (CAST('0x' || SHA256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS r, COUNT(*) OVER () AS n
           FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
""".strip(),
}
