"""Token, n-gram, stem, phrase and sentiment queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalink.functions import text as tx
from catalink.functions.stem import stem
from catalink.operators import keywords, sentiment, vectorize
from catalink.plans import sqltext as sq
from catalink.plans.registry import query
from catalink.plans.tables import (
    KEYWORD_ROWS_SQL, app_parts, documents, keyword_rows, posts, post_texts, table,
)
from catalink.session import landed
from catalink.sources import readers
from catalink.words import (
    STEM_FINAL_SUFFIXES, STEM_LONG_SUFFIXES, STEM_SHORT_SUFFIXES,
)


def _url_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the URL of the page of the same number at the end."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    joined = documents(spark, sf_dir, "doc_id", "text").join(pages, "doc_id", "left")
    tail = F.coalesce(F.concat(F.lit(" "), "url"), F.lit(""))
    return joined.select("doc_id", F.concat("text", tail).alias("text"))


URL_TEXTS = """
url_texts AS (SELECT doc_id, text || coalesce(' ' || url, '') AS text
              FROM documents LEFT JOIN pages ON page_id = doc_id)
"""


def _token_sql(expression: str) -> str:
    return f"""
WITH {URL_TEXTS}, t AS (SELECT doc_id, {expression} AS t FROM url_texts)
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM t
"""


def _tokens(spark: SparkSession, sf_dir: str, tokens: Column) -> DataFrame:
    rows = _url_texts(spark, sf_dir).select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"),
                       F.array_join("t", "|").alias("tokens"))




@query(_token_sql(sq.tokens("text")))
def tokens_lowercase(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.tokenize(F.col("text")))


@query(_token_sql(sq.unstopped("text")))
def stop_words_removed(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.drop_stop_words(tx.tokenize(F.col("text"))))


@query(_token_sql(f"[CASE WHEN starts_with(x, 'http') THEN '<url>' ELSE x END FOR x IN {sq.tokens('text')}]"))
def links_marked(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.mark_links(tx.tokenize(F.col("text"))))


@query(_token_sql(f"[CASE WHEN starts_with(x, '@') THEN '<username>' ELSE x END FOR x IN {sq.tokens('text')}]"))
def mentions_marked(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.mark_mentions(tx.tokenize(F.col("text"))))


@query(_token_sql(rf"[x FOR x IN {sq.tokens('text')} IF NOT regexp_full_match(x, '\p{{Nd}}*')]"))
def numbers_dropped(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.drop_numbers(tx.tokenize(F.col("text"))))


@query(_token_sql(f"[replace(x, '#', '') FOR x IN {sq.tokens('text')}]"))
def hash_signs_dropped(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.drop_hash_signs(tx.tokenize(F.col("text"))))


@query(_token_sql(rf"[regexp_replace(x, '[^\x00-\x7F]', '', 'g') FOR x IN {sq.tokens('text')}]"))
def non_ascii_dropped(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.drop_non_ascii(tx.tokenize(F.col("text"))))


@query(_token_sql(rf"[regexp_replace(x, '[^\p{{L}}\p{{Nd}}]+', '', 'g') FOR x IN {sq.tokens('text')}]"))
def symbols_dropped(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.drop_symbols(tx.tokenize(F.col("text"))))


@query(_token_sql(sq.cleaned("text")))
def clean_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, tx.clean_tokens(F.col("text")))


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS post_id, {sq.cleaned('text')} AS t FROM conversations),
w AS (SELECT post_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS position FROM t),
d AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM w))
SELECT post_id, CAST(position AS INTEGER) AS position, word_id FROM w JOIN d USING (word)
""")
def word_positions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"),
        tx.clean_tokens(F.col("text")).alias("tokens"))
    return vectorize.word_positions(landed(turns, "tokens"), "post_id", "tokens")


def _swap_sql(word: str, table: dict[str, str], runs: str) -> str:
    """One suffix step over a column named ``word``; the longest suffix decides."""
    found = f"regexp_extract({word}, '({'|'.join(table)})$')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    cut = f"left({word}, length({word}) - length({found}))"
    return (f"CASE WHEN {found} <> '' AND regexp_matches({cut}, '{runs}') "
            f"THEN {cut} || CASE {found} {cases} ELSE '' END ELSE {word} END")


ONE, TWO = "[aeiouy][^aeiouy]", "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
FINALS = "|".join(s for s in STEM_FINAL_SUFFIXES if s != "ion")
STEM_SQL = f"""
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '([aeiou])y', '\\1Y', 'g'), '^y', 'Y') AS w FROM words),
s1 AS (SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2)
                         WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN w LIKE '%eed' THEN NULL
                            WHEN regexp_matches(w, '[aeiouy].*ed$') THEN left(w, length(w) - 2)
                            WHEN regexp_matches(w, '[aeiouy].*ing$') THEN left(w, length(w) - 3) END AS cut FROM s1),
s3 AS (SELECT word, CASE
         WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{ONE}') THEN left(w, length(w) - 1) ELSE w END
         WHEN cut IS NULL THEN w
         WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
         WHEN length(cut) > 2 AND right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(cut, '[^aeiouylsz]$') THEN left(cut, length(cut) - 1)
         WHEN regexp_matches(cut, '{ONE}') AND NOT regexp_matches(cut, '{TWO}') AND regexp_matches(cut, '{CVC}') THEN cut || 'e'
         ELSE cut END AS w FROM s2),
s4 AS (SELECT word, regexp_replace(w, '([aeiouy].*)[yY]$', '\\1i') AS w FROM s3),
s5 AS (SELECT word, {_swap_sql('w', STEM_LONG_SUFFIXES, ONE)} AS w FROM s4),
s6 AS (SELECT word, {_swap_sql('w', STEM_SHORT_SUFFIXES, ONE)} AS w FROM s5),
s7 AS (SELECT word, CASE
         WHEN regexp_matches(w, '[st]ion$') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{TWO}') THEN left(w, length(w) - 3) ELSE w END
         WHEN regexp_matches(w, '({FINALS})$') THEN CASE
           WHEN regexp_matches(left(w, length(w) - length(regexp_extract(w, '({FINALS})$'))), '{TWO}')
           THEN left(w, length(w) - length(regexp_extract(w, '({FINALS})$'))) ELSE w END
         ELSE w END AS w FROM s6),
s8 AS (SELECT word, CASE WHEN w LIKE '%e' AND (regexp_matches(w, '{TWO}') OR
         (regexp_matches(w, '{ONE}') AND NOT regexp_matches(left(w, length(w) - 1), '{CVC}'))) THEN left(w, length(w) - 1) ELSE w END AS w FROM s7),
s9 AS (SELECT word, CASE WHEN regexp_matches(w, '.ll$') AND regexp_matches(w, '{TWO}') THEN left(w, length(w) - 1) ELSE w END AS w FROM s8)
"""


@query(f"""
WITH words AS (SELECT DISTINCT unnest({sq.cleaned('text')}) AS word FROM documents), {STEM_SQL}
SELECT word, CASE WHEN length(word) < 3 THEN word ELSE w END AS stem FROM s9
""")
def stemmed_vocabulary(spark, sf_dir):
    """Each distinct word of the documents with its stem."""
    texts = documents(spark, sf_dir, "text")
    words = texts.select(F.explode(F.array_distinct(tx.clean_tokens(F.col("text")))).alias("word"))
    return words.distinct().select("word", stem(F.col("word")).alias("stem"))


@query(f"""
WITH toks AS (SELECT doc_id, {sq.cleaned('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM toks),
g AS (SELECT doc_id, pos, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS gram FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT d.doc_id, count(gram) AS n_grams, coalesce(string_agg(gram, '|' ORDER BY pos), '') AS grams
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id AND gram IS NOT NULL GROUP BY d.doc_id
""")
def trigrams(spark, sf_dir):
    grams = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", tx.ngrams(tx.clean_tokens(F.col("text")), 3).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n_grams"),
                        F.array_join("g", "|").alias("grams"))


@query(f"""
WITH toks AS (SELECT doc_id, {sq.phrase_words('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM toks),
g AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, a AS run FROM g UNION ALL
      SELECT doc_id, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL
      SELECT doc_id, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL)
SELECT doc_id, count(*) AS n_runs, count(DISTINCT run) AS n_distinct, sum(length(run))::BIGINT AS n_chars
FROM r GROUP BY doc_id
""")
def sub_sequences(spark, sf_dir):
    runs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", tx.let(
            tx.sub_sequences(tx.phrase_words(F.col("text")), 3),
            lambda r: F.struct(
                F.size(r).cast("long").alias("n_runs"),
                F.size(F.array_distinct(r)).cast("long").alias("n_distinct"),
                F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"),
            )).alias("s"))
    return runs.select("doc_id", "s.*").where("n_runs > 0")


PHRASES_SQL = f"""
{KEYWORD_ROWS_SQL},
phrases AS (
  SELECT DISTINCT phrase FROM (
    SELECT array_to_string({sq.phrase_words('f')}, ' ') AS phrase
    FROM (SELECT unnest(fields) AS f FROM keyword_rows WHERE NOT list_contains(fields, 'unfound')))
  WHERE length(phrase) > 2 AND phrase NOT IN ({sq.PHRASE_STOPS}))
"""


@query(f"WITH {PHRASES_SQL} SELECT phrase FROM phrases")
def phrase_dictionary(spark, sf_dir):
    return keywords.phrase_dictionary(keyword_rows(spark, sf_dir))


@query(f"""
WITH {PHRASES_SQL},
toks AS (SELECT doc_id, {sq.phrase_words('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM toks),
g AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT DISTINCT doc_id, run FROM (
      SELECT doc_id, a AS run FROM g UNION ALL
      SELECT doc_id, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL
      SELECT doc_id, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL))
SELECT doc_id AS post_id, count(*) AS n_phrases FROM r JOIN phrases ON run = phrase GROUP BY doc_id
""")
def phrase_matches(spark, sf_dir):
    phrases = keywords.phrase_dictionary(keyword_rows(spark, sf_dir))
    return keywords.phrase_matches(post_texts(spark, sf_dir), phrases)


@query(f"""
WITH t AS (SELECT doc_id, {sq.prepared('text')} AS t FROM documents)
SELECT doc_id, len(t) AS n_words, array_to_string(t, '|') AS words FROM t
""")
def prepared_words(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", tx.prep_words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_words"), F.array_join("t", "|").alias("words"))


@query("""SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages""")
def html_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.strip_tags(F.col("html")).alias("text"))


@query(rf"""
WITH t AS (SELECT doc_id, unnest({sq.tokens('text')}) AS token FROM documents)
SELECT doc_id, count(*) FILTER (regexp_full_match(token, '\p{{Nd}}*')) AS n_numeric, count(*) AS n_tokens
FROM t GROUP BY doc_id
""")
def numeric_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", tx.tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select(
        "doc_id", F.size(F.filter("t", tx.is_numeric)).cast("long").alias("n_numeric"),
        F.size("t").cast("long").alias("n_tokens"))


@query("""
SELECT topic, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (
  SELECT CASE WHEN contains(lower(text), 'tion') THEN 'tion' ELSE 'other' END AS topic, n_chars FROM documents)
GROUP BY topic
""")
def topic_routing(spark, sf_dir):
    topic = tx.topic_of(F.col("text"), "tion", "tion", "other")
    return table(spark, sf_dir, "documents").groupBy(topic.alias("topic")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"""
WITH {sq.POSTS}
SELECT id, len(urls) AS n_urls, n_media, followers, reply_to > -1 AS is_reply FROM posts
""")
def entity_columns(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "id", F.size("urlEntities").alias("n_urls"), F.size("mediaEntities").alias("n_media"),
        F.col("user.followersCount").alias("followers"),
        (F.col("inReplyToUserId") > -1).alias("is_reply"))


# ---------------------------------------------------------------- keywords

@query(f"""
WITH {KEYWORD_ROWS_SQL},
w AS (SELECT unnest({sq.prepared('f')}) AS word FROM (SELECT unnest(fields) AS f FROM keyword_rows))
SELECT word FROM w GROUP BY word HAVING count(*) = 1
""")
def unique_keywords(spark, sf_dir):
    phrases = keyword_rows(spark, sf_dir).select(F.explode("fields").alias("phrase"))
    return keywords.unique_words(phrases)


def _unique_post_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur once across the texts of all items."""
    return keywords.unique_words(table(spark, sf_dir, "benchmark"), "text")


@query(f"""
WITH k AS (SELECT word FROM (SELECT unnest({sq.prepared('text')}) AS word FROM benchmark)
           GROUP BY word HAVING count(*) = 1),
p AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({sq.prepared('text')}) AS word FROM documents))
SELECT doc_id AS post_id, count(*) AS n_hits FROM p JOIN k USING (word) GROUP BY doc_id
""")
def keyword_membership(spark, sf_dir):
    return keywords.keyword_hits(post_texts(spark, sf_dir),
                                 _unique_post_words(spark, sf_dir))


APP_WORDS_SQL = r"""
apps AS (SELECT CAST(item_id AS VARCHAR) AS app_id,
                list_concat([CAST(item_id AS VARCHAR)],
                            flatten([string_split(x, ' ') FOR x IN string_split(replace(text, chr(10), ' '), repeat(' ', 8))])) AS words
         FROM benchmark)
"""


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = app_parts(spark, sf_dir)
    return readers.app_words(lines.select(readers.parse_app_text(F.col("value")).alias("parts")))


@query(f"WITH {APP_WORDS_SQL} SELECT DISTINCT unnest(words) AS word FROM apps")
def distinct_app_words(spark, sf_dir):
    return keywords.distinct_words(_apps(spark, sf_dir))


KEYWORDS_SQL = f"""
t AS (SELECT doc_id AS post_id, {sq.blank_split('text')} AS t FROM documents),
runs AS (SELECT post_id, term, count(*) AS tf FROM (SELECT post_id, unnest(t) AS term FROM t) GROUP BY ALL),
b AS (SELECT post_id, term, tf, ('0x' || left(md5(term), 7))::BIGINT % 1048576 AS bucket FROM runs),
bt AS (SELECT post_id, bucket, sum(tf) AS btf FROM b GROUP BY ALL),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM bt GROUP BY bucket)
"""


@query(f"""
WITH {KEYWORDS_SQL},
k AS (SELECT b.post_id, term, tf, floor(len(t.t) * 0.2) AS budget, round(btf * idf, 9) AS weight
      FROM b JOIN bt USING (post_id, bucket) JOIN idf USING (bucket) JOIN t USING (post_id)),
o AS (SELECT *, sum(tf) OVER (PARTITION BY post_id ORDER BY weight DESC, term
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tf AS before FROM k)
SELECT post_id, term, least(tf, budget - before)::BIGINT AS copies FROM o WHERE budget - before > 0
""")
def post_keywords(spark, sf_dir):
    tokens = post_texts(spark, sf_dir).select(
        "post_id", tx.java_split(F.col("text")).alias("tokens"))
    return keywords.post_keywords(tokens)


@query(f"""
WITH {KEYWORDS_SQL}
SELECT post_id, bucket::INTEGER AS bucket, round(btf * idf, 6) AS weight FROM bt JOIN idf USING (bucket)
""")
def hashed_tfidf(spark, sf_dir):
    tokens = post_texts(spark, sf_dir).select(
        "post_id", tx.java_split(F.col("text")).alias("tokens"))
    return vectorize.hashed_tfidf(tokens, "post_id", "tokens").withColumn(
        "weight", F.round("weight", 6))


@query(f"""
WITH {KEYWORDS_SQL}, {APP_WORDS_SQL},
k AS (SELECT b.post_id, term, tf, floor(len(t.t) * 0.2) AS budget, round(btf * idf, 9) AS weight
      FROM b JOIN bt USING (post_id, bucket) JOIN idf USING (bucket) JOIN t USING (post_id)),
o AS (SELECT *, sum(tf) OVER (PARTITION BY post_id ORDER BY weight DESC, term
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tf AS before FROM k),
aw AS (SELECT DISTINCT app_id, unnest(words) AS word FROM apps),
folded AS (SELECT DISTINCT app_id, lower(word) AS folded FROM aw)
SELECT post_id, term, app_id FROM o JOIN folded ON folded = lower(term)
WHERE budget - before > 0 AND term IN (SELECT word FROM aw)
""")
def token_app_matches(spark, sf_dir):
    return keywords.token_app_matches(post_keywords(spark, sf_dir), _apps(spark, sf_dir))


# ---------------------------------------------------------------- sentiment

# The lexicon is read off the labels: a word counts as positive when at least 90 % of the
# labelled documents holding it are of good quality, as negative when at most 55 % are.

def derived_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, sign) of all words that qualify."""
    labelled = documents(spark, sf_dir, "doc_id", "text").join(
        table(spark, sf_dir, "labels"), "doc_id")
    words = labelled.select(
        "quality", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Nd}']+")))
        .alias("word")).where("word <> ''")
    shares = words.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).where("n >= 5")
    sign = F.when(F.col("good") * 100 >= F.col("n") * 90, 1).when(
        F.col("good") * 100 <= F.col("n") * 55, -1)
    return landed(shares.select("word", sign.alias("sign")).where("sign IS NOT NULL"), "lexicon")


LEXICON_SQL = rf"""
lw AS (SELECT DISTINCT doc_id, quality, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}'']+')) AS word
       FROM documents JOIN labels USING (doc_id)),
shares AS (SELECT word, count(*) AS n, sum(quality) AS good FROM lw WHERE word <> '' GROUP BY word HAVING count(*) >= 5),
good AS (SELECT word FROM shares WHERE good * 100 >= n * 90),
bad AS (SELECT word FROM shares WHERE good * 100 <= n * 55)
"""
SENTIMENT_SQL = rf"""
{LEXICON_SQL},
parts AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k
          FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS s FROM documents)),
sents AS (SELECT doc_id, k, trim(s, ' ') AS s FROM parts WHERE trim(s, ' ') <> ''),
sw AS (SELECT doc_id, k, unnest(string_split_regex(lower(s), '[^\p{{L}}\p{{Nd}}'']+')) AS word FROM sents),
bal AS (SELECT doc_id, k, count(g.word) - count(b.word) AS balance
        FROM sw LEFT JOIN good g ON g.word = sw.word LEFT JOIN bad b ON b.word = sw.word GROUP BY doc_id, k),
means AS (SELECT doc_id, sum(length(s)::DOUBLE * (2 + greatest(-2, least(2, balance)))) / sum(length(s)) AS m
          FROM sents JOIN bal USING (doc_id, k) GROUP BY doc_id),
scores AS (SELECT d.doc_id, coalesce(m, -1) AS m,
             CASE WHEN coalesce(m, -1) <= 0 THEN 0 WHEN m < 1 THEN -2 WHEN m < 2 THEN -1 WHEN m < 3 THEN 0
                  WHEN m < 4 THEN 1 WHEN m < 5 THEN 2 ELSE 0 END AS score
           FROM documents d LEFT JOIN means USING (doc_id))
"""


@query(f"WITH {SENTIMENT_SQL} SELECT doc_id, round(m, 6) AS mean, score FROM scores")
def post_sentiment(spark, sf_dir):
    rows = sentiment.sentiment_means(documents(spark, sf_dir, "doc_id", "text"),
                                     derived_lexicon(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.round("m", 6).alias("mean"),
                       sentiment.sentiment_score(F.col("m")).alias("score"))
