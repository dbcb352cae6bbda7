"""Folds, samples, classifiers, factorisation and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalink.functions.ids import fold_sql, seeded_key_sql
from catalink.operators import (
    factor, features, labels, lattice, learn, link, metrics, sampling, subspace,
)
from catalink.plans import programs, sqltext as sq
from catalink.plans.link_queries import TALK_ITEMS, TALK_POSTS
from catalink.plans.record_queries import mislinked
from catalink.plans.registry import query
from catalink.plans.tables import item_texts, post_texts, posts, table, talk_texts, term_corpus
from catalink.plans.text_queries import STEM_SQL
from catalink.session import landed


# ---------------------------------------------------------------- folds and samples

@query(f"SELECT doc_id, quality, {fold_sql('doc_id', 5, 412)} AS fold FROM labels")
def fold_assignment(spark, sf_dir):
    return sampling.with_fold(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "quality", "fold")


@query(f"""
SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL
SELECT doc_id, toxic FROM (
  SELECT doc_id, toxic, row_number() OVER (ORDER BY {seeded_key_sql('doc_id', 11)}, doc_id) AS rn FROM labels WHERE toxic = 0)
WHERE rn <= (SELECT count(*) FROM labels WHERE toxic = 1)
""")
def undersampled(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return sampling.undersample(rows, "doc_id", "toxic")


# ---------------------------------------------------------------- classifiers

def _binary_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as binary app features, labelled by their class number as a count.

    Written out, because every fold of every model reads them.
    """
    rows = labels.with_labels(table(spark, sf_dir, "embeddings"), "label", 5)
    bits = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return landed(rows.select(F.col("vec_id").alias("app_id"), "label", bits.alias("features")),
                  "apps")


def _model_area(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    folds = learn.folds_of(_binary_apps(spark, sf_dir), "app_id")
    return spark.createDataFrame([(model, learn.mean_auprc(model, folds))],
                                 "model string, auprc double")


@query()
def naive_bayes_auprc(spark, sf_dir):
    return _model_area(spark, sf_dir, "naive_bayes")


@query()
def linear_svm_auprc(spark, sf_dir):
    return _model_area(spark, sf_dir, "linear_svm")


@query()
def logistic_regression_auprc(spark, sf_dir):
    return _model_area(spark, sf_dir, "logistic_regression")


@query()
def random_forest_auprc(spark, sf_dir):
    return _model_area(spark, sf_dir, "random_forest")


def _joint_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App features alone and next to the averaged metrics of the app's posts.

    A conversation's first turn describes the app of its number; posts are linked to it by text.
    """
    described = talk_texts(spark, sf_dir)[1]
    post_terms, item_terms, model = term_corpus(post_texts(spark, sf_dir), described, min_df=2)
    links = link.best_items(post_terms, item_terms, model).select(
        "post_id", F.col("item_id").alias("app_id"))
    rows = features.post_metrics(posts(spark, sf_dir))
    vectors = rows.select(F.col("id").alias("post_id"), labels.numeric_array(rows).alias("vector"))
    return landed(features.linked_features(landed(links, "links"), vectors,
                                           _binary_apps(spark, sf_dir)), "joint")


@query()
def with_and_without_posts(spark, sf_dir):
    """auPRC of every model with app features alone and with post features added."""
    return learn.compare(_joint_apps(spark, sf_dir), "app_id", "features", "joint")


@query()
def mislabelled_auprc(spark, sf_dir):
    """Trained on the label of the estimated app, scored against the true app's label."""
    rows = mislinked(spark, sf_dir)
    joint = landed(rows.select(
        "post_id", "label", "real_label",
        features.combined(F.col("features"), F.col("vector")).alias("features")), "mislinked")
    models = ("naive_bayes", "logistic_regression", "random_forest")
    folds = learn.folds_of(joint, "post_id")
    return spark.createDataFrame([(m, learn.mean_auprc(m, folds)) for m in models],
                                 "model string, auprc double")


def _dated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) labelled orders: before 1998 and from then on; open ones are negative,
    finished ones positive, pending ones undecided."""
    status = F.col("o_orderstatus")
    priority = [F.when(F.col("o_orderpriority").startswith(str(k)), 1.0).otherwise(0.0)
                for k in range(1, 6)]
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate",
        F.when(status == "F", 1.0).when(status == "O", 0.0).alias("label"),
        F.array(*priority, F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0),
                F.month("o_orderdate").cast("double")).alias("features"),
    ).where(F.col("label").isNotNull())
    rows = landed(rows, "dated")
    old = F.year("o_orderdate") < 1998
    return (rows.where(old).drop("o_orderdate"), rows.where(~old).drop("o_orderdate"))


@query()
def old_train_new_test(spark, sf_dir):
    return learn.dated_experiment(*_dated(spark, sf_dir), "o_orderkey")


@query()
def positive_unlabelled_test(spark, sf_dir):
    """Label-regularised logistic regression on old positives and unlabelled new rows."""
    return learn.positive_unlabelled_experiment(*_dated(spark, sf_dir), "o_orderkey")


@query("""
WITH r AS (SELECT o_orderkey, year(o_orderdate) < 1998 AS old, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS label
           FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT old, label, count(*) AS n FROM r GROUP BY old, label
""")
def dated_class_balance(spark, sf_dir):
    old, new = _dated(spark, sf_dir)
    both = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    return both.groupBy("old", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


def _accuracy_sql(n: int, form: str, stem: bool) -> str:
    """Posts ranked and the share whose true item comes first, by brute force."""
    weigh = "tf" if form == "count" else "tf * ln((n + 1.0) / (df + 1.0))"
    ctes = sq.weights(TALK_POSTS, TALK_ITEMS, n=n).replace(
        "tf * ln((n + 1.0) / (df + 1.0)) AS w", f"{weigh} AS w")
    if stem:
        # stems of all words, put back in the place of the words
        ctes = ctes.replace("toks AS (", "plain AS (") .replace(
            "singles AS (" if n > 1 else "words AS (", f"""
words AS (SELECT DISTINCT unnest(t) AS word FROM plain), {STEM_SQL},
spread AS (SELECT side, id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM plain),
toks AS (SELECT side, id, list(CASE WHEN length(word) < 3 THEN word ELSE w END ORDER BY pos) AS t
         FROM spread JOIN s9 USING (word) GROUP BY side, id),
""" + ("singles AS (" if n > 1 else "terms AS ("), 1)
        if n > 1:
            ctes = ctes.replace("words AS (SELECT * FROM grams", "terms AS (SELECT * FROM grams")
        ctes = ctes.replace("count(*) AS tf FROM words", "count(*) AS tf FROM terms")
    return f"""
SELECT {n} AS n, 1 AS min_df, {str(stem).lower()} AS stem, '{form}' AS form, count(*) AS n_posts,
       avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END) AS accuracy
FROM (WITH {ctes}, {sq.similarities()},
      posts AS (SELECT DISTINCT post_id, post_id // 1000 AS true_item_id FROM sims
                WHERE post_id // 1000 IN (SELECT id FROM w WHERE side = 'i')),
      own AS (SELECT p.post_id, coalesce(s, 0) AS s FROM posts p LEFT JOIN sims x
              ON x.post_id = p.post_id AND x.item_id = p.true_item_id)
      SELECT o.post_id, count(x.s) AS rank FROM own o
      LEFT JOIN sims x ON x.post_id = o.post_id AND x.s > o.s GROUP BY o.post_id)
"""


GRID = [(n, form, stem) for n in (1, 2) for form in ("count", "tfidf") for stem in (False, True)]


@query(" UNION ALL ".join(f"SELECT * FROM ({_accuracy_sql(*g)})" for g in GRID))
def parameter_grid(spark, sf_dir):
    """Ground-truth accuracy for combinations of n, weight form and stemming."""
    options = [programs.TextOptions(n=n, form=form, stem=stem, min_active=0)
               for n, form, stem in GRID]
    return programs.grid(*talk_texts(spark, sf_dir), options)


MIN_DFS, FORMS = (1, 2, 3, 5, 7), ("count", "binary", "tfidf")
LEVELS_SQL = ", ".join(f"avg(CASE WHEN rank <= {x} * total THEN 1.0 ELSE 0.0 END) AS recall_{round(100 * x):02d}"
                       for x in lattice.LEVELS)


def _ranking_sql(n: int) -> str:
    """Quality of the ranking for all minimum frequencies and forms of n-grams, by brute force."""
    settings = ", ".join(f"({m}, '{f}')" for m in MIN_DFS for f in FORMS)
    return f"""
SELECT {n} AS n, m AS min_df, false AS stem, f AS form, count(*) AS n_posts,
       count(*) FILTER (rank = 0) AS n_exact, avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END) AS accuracy,
       {LEVELS_SQL}, round(coalesce(avg(top) FILTER (rank = 0), 0), 6) AS mean_right,
       round(coalesce(avg(top) FILTER (rank > 0), 0), 6) AS mean_wrong
FROM (WITH {sq.weights(TALK_POSTS, TALK_ITEMS, 1, n).split("raw AS (")[0]}
      settings(m, f) AS (VALUES {settings}),
      raw AS (SELECT m, f, side, id, term, CASE f WHEN 'count' THEN tf WHEN 'binary' THEN 1.0
                     ELSE tf * ln((n + 1.0) / (df + 1.0)) END AS w
              FROM tf JOIN stats USING (term), docs, settings WHERE df >= m),
      norm AS (SELECT m, f, side, id, sqrt(sum(w * w)) AS len FROM raw GROUP BY m, f, side, id),
      w AS (SELECT m, f, side, id, term, w / len AS w FROM raw JOIN norm USING (m, f, side, id) WHERE len > 0),
      sims AS (SELECT * FROM (SELECT p.m, p.f, p.id AS post_id, i.id AS item_id, round(sum(p.w * i.w), 9) AS s
               FROM w p JOIN w i ON p.term = i.term AND p.m = i.m AND p.f = i.f
               WHERE p.side = 'p' AND i.side = 'i' GROUP BY ALL) WHERE s > 0),
      own AS (SELECT m, f, post_id, max(s) AS top, coalesce(max(s) FILTER (item_id = post_id // 1000), 0) AS own
              FROM sims GROUP BY m, f, post_id),
      known AS (SELECT o.* FROM own o JOIN (SELECT DISTINCT m, f, id FROM w WHERE side = 'i') k
                ON k.m = o.m AND k.f = o.f AND k.id = o.post_id // 1000),
      ranks AS (SELECT k.m, k.f, k.post_id, any_value(k.top) AS top, count(x.s) AS rank FROM known k
                LEFT JOIN sims x ON x.m = k.m AND x.f = k.f AND x.post_id = k.post_id AND x.s > k.own
                GROUP BY k.m, k.f, k.post_id)
      SELECT *, count(*) OVER (PARTITION BY m, f) AS total FROM ranks)
GROUP BY m, f"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_ranking_sql(n)})" for n in (1, 2, 3)))
def ranking_grid(spark, sf_dir):
    """Exact matches and recall for n, minimum frequency and form, without a reducer."""
    found = programs.ranking_grid(*talk_texts(spark, sf_dir), (1, 2, 3), MIN_DFS, FORMS)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_right", "mean_wrong")})


@query()
def reducer_grid(spark, sf_dir):
    """The same measures in reduced spaces: reducer, number of components, alpha."""
    return programs.reducer_grid(*talk_texts(spark, sf_dir), programs.TextOptions(n=1, min_df=2),
                                 (4, 16), (50.0, 200.0))


# ---------------------------------------------------------------- factorisation

def _talk_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Long weights of ground-truth posts and items under one key, and the vocabulary size."""
    p, i, model = term_corpus(*talk_texts(spark, sf_dir))
    rows = p.select(F.concat(F.lit("p"), F.col("post_id").cast("string")).alias("key"), "terms") \
        .unionByName(i.select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("key"), "terms"))
    return landed(model.weights(rows).select("key", "idx", "weight"), "weights"), model.size


def _factors(spark: SparkSession, sf_dir: str, **fit) -> DataFrame:
    weights, _ = _talk_weights(spark, sf_dir)
    return factor.implicit_factors(weights, "key", **fit)


def _split(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    number = F.substring("key", F.lit(2), F.length("key")).cast("long")
    side = F.substring("key", 1, 1)
    return (vectors.where(side == "p").select(number.alias("post_id"), "vector"),
            vectors.where(side == "i").select(number.alias("item_id"), "vector"))


@query(f"""
WITH t AS (SELECT CASE WHEN turn > 0 THEN 'p' || (conv_id * 1000 + turn) ELSE 'i' || conv_id END AS key,
                  {sq.cleaned('text')} AS t FROM conversations)
SELECT key, 8 AS width FROM t WHERE len(t) > 0
""")
def factor_vectors(spark, sf_dir):
    """Implicit-feedback factors of every text with at least one term."""
    vectors = _factors(spark, sf_dir, rank=8, iterations=3, shift=5.0)
    return vectors.select("key", F.size("vector").alias("width"))


def _with_truth(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    post_vectors, item_vectors = _split(vectors)
    return (post_vectors.withColumn("true_item_id", F.floor(F.col("post_id") / 1000)), item_vectors)


@query()
def reduced_item_ranks(spark, sf_dir):
    """Rank of each post's true item in a space of sixteen term directions."""
    return factor.dense_ranks(*_with_truth(landed(
        _directions(spark, sf_dir, 16, False).projected(), "projected")))


@query()
def reduced_ranking_quality(spark, sf_dir):
    """Exact matches and recall levels of the true item among factors."""
    ranks = factor.dense_ranks(*_with_truth(_factors(spark, sf_dir, rank=16)))
    return metrics.ranking_quality(landed(ranks, "ranks"))


@query()
def link_by_factors(spark, sf_dir):
    """Posts linked to items by the cosine of their factors, above 0.30."""
    post_vectors, item_vectors = _split(_factors(spark, sf_dir, rank=16, iterations=5))
    return factor.best_dense(post_vectors, item_vectors, threshold=0.3)


@query()
def svd_projection(spark, sf_dir):
    """Documents projected on the eight leading directions of the document-term matrix."""
    return _directions(spark, sf_dir, 8, False).projected()


def _component_sql(k: int, centred: bool) -> str:
    return "WITH RECURSIVE " + sq.components(TALK_POSTS, TALK_ITEMS, k, centred)


def _directions(spark: SparkSession, sf_dir: str, k: int, centred: bool) -> subspace.Directions:
    weights, width = _talk_weights(spark, sf_dir)
    return subspace.leading_directions(weights, "key", width, k, centred)


def _coordinates(directions: subspace.Directions, k: int) -> DataFrame:
    """Coordinates without their signs, which no decomposition fixes."""
    return directions.projected().select("key", *[
        F.round(F.abs(F.col("vector")[c]), 3).alias(f"c{c + 1}") for c in range(k)])


@query(_component_sql(2, True) + "SELECT key, round(abs(c1), 3) AS c1, round(abs(c2), 3) AS c2 FROM parts")
def pca_term_projection(spark, sf_dir):
    """Texts projected on the principal components of the term matrix, terms as observations."""
    return _coordinates(_directions(spark, sf_dir, 2, True), 2)


@query(_component_sql(2, False) + "SELECT key, round(abs(c1), 3) AS c1, round(abs(c2), 3) AS c2 FROM parts")
def svd_term_projection(spark, sf_dir):
    """Texts projected on term directions times singular values, held in ranges."""
    return _coordinates(_directions(spark, sf_dir, 2, False), 2)


@query(_component_sql(2, True) + """
SELECT 1 AS component, round(l1 / (n - 1), 6) AS variance FROM lam UNION ALL
SELECT 2, round(l2 / (n - 1), 6) FROM lam
""")
def pca_variances(spark, sf_dir):
    """Variances along the leading principal components of the term matrix."""
    found = _directions(spark, sf_dir, 2, True).variances.tolist()
    return spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(found)],
                                 "component int, variance double")


@query("""
SELECT vec_id, 64 AS width, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 5) AS length FROM embeddings
""")
def svd_rotation(spark, sf_dir):
    """All 64 directions, unscaled: a rotation, so every vector keeps its length."""
    rows = factor.dense_as_sparse(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    projected = factor.fit_term_space(rows, 64, 64).project(rows, "vec_id", 64, scaled=False)
    return projected.select("vec_id", F.size("vector").alias("width"), _length("vector"))


def _length(vector: str):
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return F.round(F.sqrt(squares), 5).alias("length")


@query()
def svd_several_k(spark, sf_dir):
    """One decomposition, several numbers of directions."""
    rows = factor.dense_as_sparse(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    projected = factor.fit_term_space(rows, 64, 16).project(rows, "vec_id", 64)
    return projected.select("vec_id", *factor.leading("vector", (2, 8, 16)))


@query("""
SELECT vec_id, 64 AS width, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 5) AS length FROM embeddings
""")
def pca_rotation(spark, sf_dir):
    """All 64 principal components: a rotation, so every vector keeps its length."""
    projected = factor.principal_components(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return projected.select("vec_id", F.size("vector").alias("width"), _length("vector"))


@query()
def link_by_svd(spark, sf_dir):
    """Ground-truth posts linked in the reduced space of the leading sixteen directions."""
    projected = landed(_directions(spark, sf_dir, 16, False).projected(), "projected")
    return factor.best_dense(*_split(projected), threshold=0.0)


@query()
def factor_grid(spark, sf_dir):
    """Links by reducer and number of components over one set of term weights."""
    weights, width = _talk_weights(spark, sf_dir)
    return programs.factor_grid(weights, width, "p", "i", (4, 16))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT a.d::INTEGER AS i, b.d::INTEGER AS j, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS similarity
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY a.d, b.d
""")
def column_similarities(spark, sf_dir):
    return factor.column_similarities(table(spark, sf_dir, "embeddings"), "embedding", 64).select(
        "i", "j", F.round("similarity", 6).alias("similarity"))


CELLS_SQL = """
SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS v FROM embeddings
"""


@query(f'SELECT c::INTEGER AS "row", r AS col, round(v, 6) AS value FROM ({CELLS_SQL})')
def transposed_matrix(spark, sf_dir):
    cells = factor.matrix_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return factor.transposed(cells).select(
        "row", "col", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f'SELECT r AS "row", c::INTEGER AS col, round(v, 6) AS value FROM ({CELLS_SQL}) ORDER BY 1, 2')
def sorted_matrix_rows(spark, sf_dir):
    cells = factor.matrix_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return factor.sorted_rows(cells.withColumn(
        "value", F.round(F.col("value").cast("double"), 6)))


@query("""
SELECT vec_id, 65 AS width, CAST(label AS DOUBLE) AS last, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings
""")
def combined_vectors(spark, sf_dir):
    """Two vectors one after the other."""
    both = features.combined(F.col("embedding").cast("array<double>"),
                             F.array(F.col("label").cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", both.alias("v")).select(
        "vec_id", F.size("v").alias("width"), F.element_at("v", -1).alias("last"),
        F.round(F.col("v")[0], 6).alias("first"))


@query()
def link_documents_by_factors(spark, sf_dir):
    """Trigram weights of documents and items, factorised together, linked above 0.30."""
    p, i, model = term_corpus(post_texts(spark, sf_dir), item_texts(spark, sf_dir), n=3,
                              in_buckets=True)
    rows = p.select(F.concat(F.lit("p"), F.col("post_id").cast("string")).alias("key"), "terms") \
        .unionByName(i.select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("key"), "terms"))
    weights = model.unranked_weights(rows).select("key", "idx", "weight")
    vectors = factor.implicit_factors(landed(weights, "weights"), "key", rank=16, iterations=5)
    return factor.best_dense(*_split(vectors), threshold=0.3)
