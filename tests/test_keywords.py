from catalink.operators import keywords, vectorize


def test_post_keywords_equal_brute_force_without_a_row_a_term(spark):
    rows = [(1, "a b b c d e f g h i"), (2, "b c"), (3, "z z z z z y"), (3, "y x w v u"),
            (None, "p q r s t"), (4, ""), (5, None)]
    posts = spark.createDataFrame(rows, "post_id long, text string").selectExpr(
        "post_id", "split(text, ' ') AS tokens")
    found = keywords.post_keywords(posts, fraction=0.4)
    assert "Window" not in found._jdf.queryExecution().toString()
    idf = {r["bucket"]: r["idf"] for r in vectorize.hashed_idf(posts, "tokens", 1 << 20).collect()}
    words = {w for _, t in rows if t is not None for w in t.split(" ")}
    bucket = dict(spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", vectorize.hashed_bucket(keywords.F.col("w"), 1 << 20)).collect())
    assert len(set(bucket.values())) == len(words)
    want = []
    for post in {p for p, _ in rows}:
        texts = [t.split(" ") for p, t in rows if p == post and t is not None]
        everything = [w for t in texts for w in t]
        runs = sorted((-round(everything.count(w) * idf[bucket[w]], 9), w, t.count(w), len(t))
                      for t in texts for w in set(t))
        before = 0
        for _, w, n, size in runs:
            copies = min(n, int(size * 0.4) - before)
            before += n
            if copies > 0:
                want.append((post, w, copies))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
