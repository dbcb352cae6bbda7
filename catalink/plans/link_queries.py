"""Term weights, similarity links and link quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalink.operators import joins, link, metrics, vectorize
from catalink.operators.features import mean_per_app
from catalink.operators.sampling import sample
from catalink.functions import ids
from catalink.functions.text import clean_tokens
from catalink.plans import sqltext as sq
from catalink.plans.registry import query
from catalink.plans.tables import (
    item_texts, post_texts, table, talk_texts, term_corpus,
)
from catalink.session import landed

DOCS = "SELECT doc_id AS id, text FROM documents"
ITEMS = "SELECT item_id AS id, text FROM benchmark"
TALK_POSTS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE turn > 0"
TALK_ITEMS = "SELECT conv_id AS id, text FROM conversations WHERE turn = 0"


# ---------------------------------------------------------------- term weights

def _document_terms(spark: SparkSession, sf_dir: str, n: int = 1) -> DataFrame:
    """Terms of the documents, written once for the passes that fit and weigh."""
    return landed(vectorize.with_terms(post_texts(spark, sf_dir), n=n), "terms")


DOC_RUNS = f"""
toks AS (SELECT doc_id AS post_id, {sq.cleaned('text')} AS t FROM documents),
tf AS (SELECT post_id, term, count(*) AS tf FROM (SELECT post_id, unnest(t) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term)
"""


@query(f"""
WITH {DOC_RUNS}, v AS (SELECT * FROM stats WHERE df >= 3)
SELECT post_id, term, tf::DOUBLE AS weight FROM tf JOIN v USING (term)
""")
def count_weights(spark, sf_dir):
    terms = _document_terms(spark, sf_dir)
    model = vectorize.fit_terms(terms, form="count", min_df=3)
    return model.term_weights(terms).select("post_id", "term", "weight")


@query(f"""
WITH toks AS (SELECT doc_id AS post_id, {sq.cleaned('text')} AS t FROM documents),
w AS (SELECT post_id, unnest(t) AS a, generate_subscripts(t, 1) AS pos FROM toks),
g AS (SELECT post_id, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS term FROM w
      WINDOW o AS (PARTITION BY post_id ORDER BY pos)),
tf AS (SELECT post_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY ALL)
SELECT post_id, term, tf::DOUBLE AS weight FROM tf
""")
def trigram_count_weights(spark, sf_dir):
    """Counts of every trigram: with no least frequency a row's own terms are all it takes."""
    terms = vectorize.with_terms(post_texts(spark, sf_dir), n=3)
    return vectorize.count_weights(terms).select("post_id", "term", "weight")


@query(f"""
WITH {DOC_RUNS}, v AS (SELECT * FROM stats WHERE df >= 3)
SELECT post_id, term, round(tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS weight
FROM tf JOIN v USING (term)
""")
def tfidf_weights(spark, sf_dir):
    terms = _document_terms(spark, sf_dir)
    model = vectorize.fit_terms(terms, form="tfidf", min_df=3)
    return model.term_weights(terms).select("post_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""
WITH {DOC_RUNS}, v AS (SELECT * FROM stats WHERE df >= 3)
SELECT post_id, term, CASE WHEN tf > 1.0 THEN 1.0 ELSE 0.0 END AS weight FROM tf JOIN v USING (term)
""")
def binary_weights(spark, sf_dir):
    """Strict threshold: with threshold 1 a term must occur at least twice."""
    terms = _document_terms(spark, sf_dir)
    model = vectorize.fit_terms(terms, form="count", min_df=3)
    return model.term_weights(terms).select(
        "post_id", "term", vectorize.binarized(F.col("weight"), 1.0).alias("weight"))


@query(f"""
WITH {DOC_RUNS}, v AS (SELECT * FROM stats WHERE df >= 3)
SELECT row_number() OVER (ORDER BY cnt DESC, term) - 1 AS idx, term, df AS doc_freq, cnt::BIGINT AS corpus_count FROM v
""")
def vocabulary(spark, sf_dir):
    terms = _document_terms(spark, sf_dir)
    model = vectorize.fit_terms(terms, form="count", min_df=3)
    return model.vocabulary.select(F.col("idx").cast("long").alias("idx"), "term", "doc_freq",
                                   "corpus_count")


@query(f"""
WITH {DOC_RUNS}
SELECT post_id, row_number() OVER (ORDER BY post_id) - 1 AS number FROM (SELECT doc_id AS post_id FROM documents)
""")
def post_numbers(spark, sf_dir):
    """A dense row number per post, in key order."""
    return vectorize.number_rows(post_texts(spark, sf_dir), "post_id", "number")


@query(f"""
WITH {DOC_RUNS}, v AS (SELECT * FROM stats WHERE df >= 3)
SELECT post_id, count(*) AS n_active FROM tf JOIN v USING (term) GROUP BY post_id HAVING count(*) >= 10
""")
def min_active_terms(spark, sf_dir):
    terms = _document_terms(spark, sf_dir)
    model = vectorize.fit_terms(terms, form="count", min_df=3)
    return model.term_weights(terms).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("n_active")).where("n_active >= 10")


# ---------------------------------------------------------------- links

def _best(spark: SparkSession, sf_dir: str, threshold: float = 0.1, **fit) -> DataFrame:
    posts, items, model = term_corpus(post_texts(spark, sf_dir), item_texts(spark, sf_dir),
                                      min_df=2, **fit)
    return link.best_items(posts, items, model, threshold=threshold)


LINKS_SQL = sq.weights(DOCS, ITEMS, 2) + "," + sq.similarities() + "," + sq.links(0.1)


@query(f"WITH {LINKS_SQL} SELECT post_id, item_id, round(s, 6) AS similarity FROM links")
def link_by_text(spark, sf_dir):
    """Each document's most similar item when their similarity is above 0.1."""
    return _best(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {sq.weights(DOCS, ITEMS, 1, 3)}, {sq.similarities(10)}, {sq.links(0.3)}
SELECT post_id, item_id, round(s, 6) AS similarity FROM links
""")
def link_by_trigram(spark, sf_dir):
    """Trigram links above 0.30 between texts with at least ten known trigrams."""
    posts, items, model = term_corpus(post_texts(spark, sf_dir), item_texts(spark, sf_dir), n=3)
    links = link.best_items(posts, items, model, threshold=0.3, min_active=10)
    return links.withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {sq.weights(DOCS, ITEMS, 2)}, {sq.similarities()}
SELECT post_id, count(*) AS n_items, round(sum(s), 3) AS total, round(max(s), 6) AS best,
       string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items
FROM sims GROUP BY post_id
""")
def all_similarities(spark, sf_dir):
    """Every item that shares a known term with a document, grouped by document."""
    posts, items, model = term_corpus(post_texts(spark, sf_dir), item_texts(spark, sf_dir),
                                      min_df=2)
    grouped = link.similar_items(posts, items, model)
    return grouped.select(
        "post_id", F.size("matches").cast("long").alias("n_items"),
        F.round(F.aggregate("matches.similarity", F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        F.round(F.array_max("matches.similarity"), 6).alias("best"),
        F.array_join(F.transform("matches.item_id", lambda i: i.cast("string")), ",").alias("items"))


@query(f"""
WITH {LINKS_SQL}
SELECT item_id, post_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, post_id) AS rn FROM links) WHERE rn = 1
""")
def best_post_per_item(spark, sf_dir):
    return link.best_post_per_item(_best(spark, sf_dir)).withColumn(
        "similarity", F.round("similarity", 6))


@query(f"""
WITH {LINKS_SQL}
SELECT item_id, 0 AS part, count(*) AS n_posts, string_agg(post_id::VARCHAR, ',' ORDER BY post_id) AS posts
FROM links GROUP BY item_id
""")
def posts_per_item(spark, sf_dir):
    # Written out first: the links are counted per item, then grouped.
    grouped = link.posts_per_item(landed(_best(spark, sf_dir), "links"))
    return grouped.select(
        "item_id", "part", F.size("posts").cast("long").alias("n_posts"),
        F.array_join(F.transform("posts.post_id", lambda p: p.cast("string")), ",").alias("posts"))


@query(f"""
WITH {LINKS_SQL}
SELECT item_id, post_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY post_id) AS rn FROM links) WHERE rn <= 2
""")
def first_posts_per_item(spark, sf_dir):
    return link.first_posts_per_item(_best(spark, sf_dir), 2).select(
        "item_id", "post_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH {LINKS_SQL}
SELECT n_links, count(*) AS n_keys FROM (SELECT item_id, count(*) AS n_links FROM links GROUP BY item_id) GROUP BY n_links
""")
def link_fan_out(spark, sf_dir):
    return metrics.fan_out(_best(spark, sf_dir), "item_id")


# ---------------------------------------------------------------- ground truth

RANK_CTES = f"""
{sq.weights(TALK_POSTS, TALK_ITEMS)}, {sq.similarities()},
truth AS (SELECT conv_id * 1000 + turn AS post_id, conv_id AS true_item_id FROM conversations
          WHERE turn > 0 AND conv_id IN (SELECT id FROM w WHERE side = 'i')),
own AS (SELECT t.post_id, t.true_item_id, coalesce(s.s, 0) AS s FROM truth t
        LEFT JOIN sims s ON s.post_id = t.post_id AND s.item_id = t.true_item_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, item_id) AS rn FROM sims) WHERE rn = 1),
ranks AS (SELECT o.post_id, o.true_item_id, t.item_id, t.s AS confidence,
                 (SELECT count(*) FROM sims x WHERE x.post_id = o.post_id AND x.s > o.s)::INTEGER AS rank
          FROM own o JOIN top t USING (post_id))
"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, items, model = term_corpus(*talk_texts(spark, sf_dir))
    return link.true_item_ranks(posts, items, model)


@query(f"""
WITH {RANK_CTES}
SELECT post_id, true_item_id, item_id, rank, round(confidence, 6) AS confidence FROM ranks
""")
def true_item_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


TRUTH_LINKS = f"""
{sq.weights(TALK_POSTS, TALK_ITEMS)}, {sq.similarities(10)}, {sq.links(0.0)},
graded AS (SELECT post_id, item_id, post_id // 1000 AS true_item_id, s AS confidence,
                  CASE WHEN item_id = post_id // 1000 THEN 0 ELSE 1 END AS rank FROM links)
"""


def _graded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best links of the ground-truth posts with rank 0 where the item is the true one.

    The links are written out, because the measures below read them several times.
    """
    posts, items, model = term_corpus(*talk_texts(spark, sf_dir))
    links = link.best_items(posts, items, model, min_active=10)
    truth = F.floor(F.col("post_id") / 1000)
    return landed(links.select(
        "post_id", "item_id", truth.alias("true_item_id"), F.col("similarity").alias("confidence"),
        F.when(F.col("item_id") == truth, 0).otherwise(1).alias("rank")), "links")


@query(f"""
WITH {TRUTH_LINKS}
SELECT post_id, item_id, true_item_id, rank, round(confidence, 6) AS confidence FROM graded
""")
def graded_links(spark, sf_dir):
    return _graded_links(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


CURVE_SQL = """
scored AS (SELECT CASE WHEN rank = 0 THEN 1 ELSE 0 END AS label,
                  round(confidence / (SELECT max(confidence) FROM graded), 9) AS score FROM graded),
counts_by_score AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
cum AS (SELECT score, sum(pos) OVER d AS tp, sum(n) OVER d - sum(pos) OVER d AS fp,
               sum(pos) OVER () AS p, sum(n) OVER () - sum(pos) OVER () AS q FROM counts_by_score
        WINDOW d AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall,
               tp / (tp + fp) AS precision, CASE WHEN q > 0 THEN fp / q ELSE 0 END AS fpr FROM cum),
strips AS (SELECT (recall - lag(recall, 1, 0) OVER o) * (precision + lag(precision, 1, 1) OVER o) / 2 AS pr,
                  (fpr - lag(fpr, 1, 0) OVER o) * (recall + lag(recall, 1, 0) OVER o) / 2 AS roc, fpr, recall
           FROM pts WINDOW o AS (ORDER BY score DESC)),
areas AS (SELECT sum(pr) AS auprc, sum(roc) + (1 - max(fpr)) * (1 + max(recall)) / 2 AS auroc FROM strips)
"""


QUALITY_SQL = f"""
{CURVE_SQL},
counts AS (SELECT count(*) AS n, count(*) FILTER (rank = 0) AS r, count(*) FILTER (rank <> 0) AS x,
                  avg(confidence) FILTER (rank = 0) AS cr, avg(confidence) FILTER (rank <> 0) AS cx,
                  avg(confidence) AS c FROM graded),
per_item AS (SELECT count(*) AS n, sum(hit) AS h FROM (
             SELECT item_id, max(CASE WHEN rank = 0 THEN 1 ELSE 0 END) AS hit FROM graded GROUP BY item_id)),
m AS (SELECT 'n_links' AS metric, n::DOUBLE AS value FROM counts
  UNION ALL SELECT 'n_right', r FROM counts UNION ALL SELECT 'n_wrong', x FROM counts
  UNION ALL SELECT 'mean_confidence_right', cr FROM counts
  UNION ALL SELECT 'mean_confidence_wrong', cx FROM counts
  UNION ALL SELECT 'mean_confidence', c FROM counts
  UNION ALL SELECT 'odds', r / x FROM counts UNION ALL SELECT 'accuracy', r / n FROM counts
  UNION ALL SELECT 'n_items', n FROM per_item UNION ALL SELECT 'n_items_right', h FROM per_item
  UNION ALL SELECT 'share_items_right', h / n FROM per_item
  UNION ALL SELECT 'auprc', auprc FROM areas UNION ALL SELECT 'auroc', auroc FROM areas)
"""


@query(f"""
WITH {TRUTH_LINKS}, {QUALITY_SQL}
SELECT metric, round(value, 6) AS value FROM m
""")
def link_quality(spark, sf_dir):
    return metrics.link_quality(_graded_links(spark, sf_dir)).withColumn(
        "value", F.round("value", 6))


@query(f"""
WITH {TRUTH_LINKS}, {CURVE_SQL}
SELECT round(score, 6) AS score, tp, fp, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr FROM pts
""")
def curve_points(spark, sf_dir):
    """Precision-recall and ROC points of the links by confidence."""
    scored = metrics.scored_ranks(_graded_links(spark, sf_dir))
    return metrics.curve(scored).select(
        "tp", "fp", *[F.round(c, 6).alias(c) for c in ("score", "recall", "precision", "fpr")])


_LEVELS = " UNION ALL ".join(
    f"SELECT 'within_{v:g}', count(*) FILTER (rank <= {v} * (SELECT count(*) FROM ranks))::DOUBLE FROM ranks UNION ALL "
    f"SELECT 'recall_{v:g}', count(*) FILTER (rank <= {v} * (SELECT count(*) FROM ranks)) / count(*) FROM ranks"
    for v in metrics.RECALL_LEVELS)


@query(f"""
WITH {RANK_CTES},
m AS (SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM ranks
  UNION ALL SELECT 'n_exact', count(*) FILTER (rank = 0) FROM ranks
  UNION ALL SELECT 'mean_right', coalesce(avg(confidence) FILTER (rank = 0), 0) FROM ranks
  UNION ALL SELECT 'mean_wrong', coalesce(avg(confidence) FILTER (rank <> 0), 0) FROM ranks
  UNION ALL SELECT 'mean', avg(confidence) FROM ranks
  UNION ALL SELECT 'stddev', stddev_pop(confidence) FROM ranks UNION ALL {_LEVELS})
SELECT metric, round(value, 6) AS value FROM m
""")
def ranking_quality(spark, sf_dir):
    ranks = landed(_ranks(spark, sf_dir), "ranks")
    return metrics.ranking_quality(ranks).withColumn("value", F.round("value", 6))


@query(f"""
WITH {TRUTH_LINKS}
SELECT item_id, round(coalesce(avg(confidence), 0), 6) AS mean, round(coalesce(stddev_pop(confidence), 0), 6) AS stddev
FROM graded GROUP BY item_id
""")
def confidence_statistics(spark, sf_dir):
    stats = _graded_links(spark, sf_dir).groupBy("item_id").agg(
        *metrics.mean_and_deviation(F.col("confidence")))
    return stats.select("item_id", F.round("mean", 6).alias("mean"),
                        F.round("stddev", 6).alias("stddev"))


@query(f"""
WITH {TRUTH_LINKS},
s AS (SELECT rank, round(confidence / (SELECT max(confidence) FROM graded), 9) > 0.3 AS taken FROM graded)
SELECT count(*) FILTER (taken AND rank = 0) AS taken_right, count(*) FILTER (taken AND rank <> 0) AS taken_wrong,
       count(*) FILTER (rank = 0) AS all_right, count(*) FILTER (rank <> 0) AS all_wrong,
       round(count(*) FILTER (taken AND rank = 0) / count(*) FILTER (taken), 6) AS taken_accuracy,
       round(count(*) FILTER (rank = 0) / count(*), 6) AS all_accuracy
FROM s
""")
def acceptance_summary(spark, sf_dir):
    row = metrics.acceptance_summary(_graded_links(spark, sf_dir), 0.3)
    return row.select(*row.columns[:4], *[F.round(c, 6).alias(c) for c in row.columns[4:]])


@query(f"""
WITH {TRUTH_LINKS},
s AS (SELECT * FROM graded WHERE round(confidence / (SELECT max(confidence) FROM graded), 9) > 0.3)
SELECT s.post_id, s.item_id, c.turn, length(c.text) AS n_chars FROM s JOIN conversations c ON c.conv_id = s.item_id
""")
def accepted_link_texts(spark, sf_dir):
    """Accepted links with every text of their estimated item; several texts multiply."""
    links = metrics.accepted(_graded_links(spark, sf_dir), 0.3)
    texts = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "item_id")
    return joins.lookup_join(links, texts, "item_id").select(
        "post_id", "item_id", "turn", F.length("text").cast("long").alias("n_chars"))


@query(f"""
WITH {TRUTH_LINKS}, {CURVE_SQL}
SELECT round(min(score) * (SELECT max(confidence) FROM graded), 6) AS threshold, max(tp + fp)::BIGINT AS n_kept
FROM pts WHERE precision >= 0.5
""")
def confidence_threshold(spark, sf_dir):
    """The lowest confidence from which on at least half of the links are right."""
    picked = metrics.lowest_threshold(_graded_links(spark, sf_dir), 0.5)
    return picked.select(F.round("threshold", 6).alias("threshold"), "n_kept")


# ---------------------------------------------------------------- corpus shape

@query("""
SELECT 'item' AS side, conv_id AS id, length(text) AS n_chars FROM conversations WHERE turn = 0 AND conv_id IS NOT NULL
UNION ALL SELECT 'post', conv_id, length(text) FROM conversations WHERE turn > 0 AND conv_id IS NOT NULL
""")
def sided_corpus(spark, sf_dir):
    """Both sides of the linking corpus with a side column and no missing ids."""
    return _sided(spark, sf_dir).select(
        "side", "id", F.length("text").cast("long").alias("n_chars"))


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull())
    side = F.when(F.col("turn") == 0, "item").otherwise("post")
    return turns.select(side.alias("side"), F.col("conv_id").alias("id"), "text")


@query(f"""
WITH c AS (SELECT CASE WHEN turn = 0 THEN 'item' ELSE 'post' END AS side, conv_id AS id, {sq.cleaned('text')} AS t FROM conversations),
k AS (SELECT * FROM c WHERE len(list_distinct(t)) >= 20),
b AS (SELECT id FROM k GROUP BY id HAVING count(DISTINCT side) = 2)
SELECT side, id, count(*) AS n FROM k WHERE id IN (SELECT id FROM b) GROUP BY side, id
""")
def two_sided_apps(spark, sf_dir):
    """Apps that keep both an item text and a post after texts with few terms were dropped."""
    rows = _sided(spark, sf_dir).withColumn("tokens", clean_tokens(F.col("text")))
    kept = rows.where(F.size(F.array_distinct("tokens")) >= 20).select("side", "id")
    return joins.two_sided(kept, "id").groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT doc_id AS post_id, n_chars FROM documents
WHERE {ids.seeded_key_sql('doc_id', 11)} < {int(0.2 * ids.PRIME)}
""")
def seeded_sample(spark, sf_dir):
    """A 20 % sample that any engine draws alike."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), "n_chars")
    return sample(docs, 0.2, 11, "post_id")


@query(f"""
WITH {LINKS_SQL}
SELECT item_id AS app_id, round(avg(s), 6) AS mean, count(*) AS n FROM links GROUP BY item_id
""")
def mean_similarity_per_item(spark, sf_dir):
    links = _best(spark, sf_dir).select(F.col("item_id").alias("app_id"),
                                        F.col("similarity").alias("score"))
    return mean_per_app(links).withColumn("mean", F.round("mean", 6))
