from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from catalink.functions import text as tx
from catalink.functions.ids import app_id_from_apk, app_id_from_query, app_id_from_url, base_name
from catalink.functions.stem import stem
from catalink.operators import sentiment


@pytest.mark.parametrize("text, tokens", [
    ("Hello  World", ["hello", "", "world"]), (" a", ["", "a"]), ("a \n", ["a"]), ("  ", []),
    ("", [""]), ("a\tb\nc", ["a", "b", "c"]),
])
def test_tokenize(one, text, tokens):
    assert one(tx.tokenize, text) == tokens


@pytest.mark.parametrize("token, cleaned", [
    ("http://t.co/x", ["url"]), ("@bob", ["username"]), ("#App", ["app"]), ("123", []), ("", []),
    ("café!", ["caf"]), ("!!!", [""]), ("١٢", []), ("@123", ["username"]), ("12,", ["12"]),
    ("don't", []), ("x²", ["x"]),
])
def test_clean_tokens(one, token, cleaned):
    assert one(tx.clean_tokens, token) == cleaned
    assert one(tx.clean_tokens_stepwise, token) == cleaned


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60), min_size=1, max_size=40))
def test_fused_cleaning_equals_the_steps(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    different = rows.where(
        tx.clean_tokens(F.col("t")) != tx.clean_tokens_stepwise(F.col("t")))
    assert different.count() == 0


def test_term_runs_count_the_tokens(spark):
    rows = [(["b", "a", "b", ""],), ([],), (["x"],), (None,)]
    got = spark.createDataFrame(rows, "t array<string>").select(tx.term_runs(F.col("t"))).collect()
    for (tokens,), (runs,) in zip(rows, got):
        assert Counter(tokens or []) == {r["term"]: r["tf"] for r in runs or []}


def test_ngrams_and_sub_sequences(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), ([],)], "t array<string>")
    grams = [r[0] for r in frame.select(tx.ngrams(F.col("t"), 3)).collect()]
    assert grams == [["a b c", "b c d"], [], []]
    runs = [sorted(r[0]) for r in frame.select(tx.sub_sequences(F.col("t"), 3)).collect()]
    assert runs[0] == sorted(["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"])
    assert runs[1:] == [["a", "a b", "b"], []]


def test_prep_words_and_phrases(one):
    assert one(tx.prep_words, "The Ángry Birds!  Now") == ["ngry", "birds", "", "now"]
    assert one(tx.phrase_key, "The Angry and Birds") == "angry birds"
    assert one(tx.strip_tags, "<p class='x'>a <b>b</b></p>") == "a b"
    assert one(lambda c: tx.topic_of(c, "trump", "trump", "clinton"), "TRUMP it") == "trump"


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("toy", "toi"), ("by", "by"),
    ("yes", "Ye"), ("feed", "feed"), ("agreed", "agre"), ("sing", "sing"), ("rolling", "roll"),
    ("hopeful", "hope"), ("relational", "relat"), ("adoption", "adopt"), ("controlling", "control"),
    ("generalizations", "gener"), ("is", "is"), ("", ""), ("opinion", "opinion"),
])
def test_stem(one, word, expected):
    assert one(stem, word) == expected


@pytest.mark.parametrize("url, app", [
    ("https://h/d?id=a.b&hl=en", "a.b"), ("?hl=en&id=a", "en"), ("?id=a", "a"), ("?id=&x=1", ""),
    ("plain", "plain"), ("a&b", "a"),
])
def test_app_id_from_url(one, url, app):
    assert one(app_id_from_url, url) == app


def test_other_ids(one):
    assert one(app_id_from_query, "https://h/d?hl=en&id=a.b") == "a.b"
    assert one(app_id_from_query, "not a url") is None
    assert one(app_id_from_apk, "com.x-12.apk") == "com.x"
    assert one(app_id_from_apk, "com.x") == ""
    assert one(base_name, "/a/b/com.x.y.apk") == "com.x.y"


@pytest.mark.parametrize("mean, score", [
    (-1.0, 0), (0.0, 0), (0.5, -2), (1.0, -1), (2.0, 0), (3.0, 1), (4.0, 2), (5.5, 0)])
def test_sentiment_scores(spark, mean, score):
    frame = spark.createDataFrame([(mean,)], "m double")
    got = frame.select(sentiment.sentiment_score(F.col("m")), sentiment.sentiment_bucket(F.col("m"))).first()
    assert got[0] == score and sentiment.SCORES[got[1]] == score


def test_sentiment_weights_sentences_by_length(one):
    mean = one(lambda c: sentiment.sentiment_mean(c, ["good"], ["bad"]), "good day. bad bad bad")
    assert mean == pytest.approx((8 * 3 + 11 * 0) / 19)
    assert one(sentiment.sentiment_mean, " .. ") == -1.0


def test_a_large_phrase_dictionary_is_joined_with_runs_that_pass_a_filter_only(spark, monkeypatch):
    from catalink.operators import keywords

    posts = spark.createDataFrame(
        [(i, f"alpha{i} beta gamma{i % 7} delta word{i} other{i}") for i in range(300)] + [(300, None), (301, "")],
        "post_id long, text string")
    phrases = spark.createDataFrame([("beta gamma3",), ("alpha5",), ("alpha9 beta gamma2",), ("none such",)], "phrase string")
    joined, plain = [], keywords.lookup_join
    monkeypatch.setattr(keywords, "lookup_join", lambda left, *a, **k: (joined.append(left.count()), plain(left, *a, **k))[1])
    want = {(r["post_id"], r["n_phrases"]) for r in keywords.phrase_matches(posts, phrases).collect()}
    got = {(r["post_id"], r["n_phrases"]) for r in keywords.phrase_matches(posts, phrases, broadcast_rows=0).collect()}
    assert got == want and (5, 1) in got and len(got) == 45
    assert joined[1] < joined[0] / 20
