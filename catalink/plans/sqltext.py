"""SQL fragments shared by the checks."""

from __future__ import annotations

from catalink.words import PHRASE_STOP_WORDS, VECTOR_STOP_WORDS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


VECTOR_STOPS = quoted(VECTOR_STOP_WORDS)
PHRASE_STOPS = quoted(PHRASE_STOP_WORDS)
BLANK = r"[ \t\n\x0B\f\r]"


def tokens(text: str) -> str:
    return (f"CASE WHEN regexp_full_match({text}, '{BLANK}+') THEN CAST([] AS VARCHAR[]) ELSE "
            f"string_split_regex(regexp_replace(lower({text}), '{BLANK}+$', ''), '{BLANK}') END")


def unstopped(text: str) -> str:
    return f"[x FOR x IN {tokens(text)} IF x NOT IN ({VECTOR_STOPS})]"


def marked(text: str) -> str:
    return (f"[CASE WHEN starts_with(x, 'http') THEN '<url>' WHEN starts_with(x, '@') "
            f"THEN '<username>' ELSE x END FOR x IN {unstopped(text)}]")


def numberless(text: str) -> str:
    return rf"[x FOR x IN {marked(text)} IF NOT regexp_full_match(x, '\p{{Nd}}*')]"


def cleaned(text: str) -> str:
    return (r"[regexp_replace(regexp_replace(replace(x, '#', ''), '[^\x00-\x7F]', '', 'g'), "
            rf"'[^\p{{L}}\p{{Nd}}]+', '', 'g') FOR x IN {numberless(text)}]")


def blank_split(text: str) -> str:
    return (f"CASE WHEN regexp_full_match({text}, ' +') THEN CAST([] AS VARCHAR[]) ELSE "
            f"string_split(rtrim({text}, ' '), ' ') END")


def phrase_words(text: str) -> str:
    return f"[x FOR x IN {blank_split(f'lower({text})')} IF x NOT IN ({PHRASE_STOPS})]"


def prepared(text: str) -> str:
    plain = rf"lower(replace(regexp_replace({text}, '[^\x00-\x7F]', '', 'g'), '!', ''))"
    return f"[x FOR x IN {blank_split(plain)} IF x NOT IN ({PHRASE_STOPS})]"


# Posts: documents with the page of the same number and their labels.
POSTS = """
posts AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source,
         CASE WHEN l.quality IS NULL THEN -1 ELSE l.quality + 10 * l.toxic END AS reply_to,
         d.n_chars AS favorite_count, coalesce(l.toxic, 0) AS retweet_count,
         list_concat(
           CASE WHEN p.url IS NULL THEN [] ELSE [p.url] END,
           CASE WHEN l.doc_id IS NULL THEN []
                ELSE ['https://play.google.com/store/apps/details?id=com.' || d.source || '&hl=' || d.lang]
           END) AS urls,
         CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS n_media,
         d.n_chars AS followers, length(d.source) AS friends,
         coalesce(l.quality, 0) AS favourites, length(d.lang) AS statuses
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def app_id(url: str) -> str:
    return (f"split_part(CASE WHEN instr({url}, '=') > 0 THEN substr({url}, instr({url}, '=') + 1) "
            f"ELSE {url} END, '&', 1)")


# Post-to-app links by store URL, one row per post and matching URL.
STORE_LINKS = POSTS.rstrip() + f""",
store_links AS (
  SELECT id AS post_id, text, {app_id('url')} AS app_id
  FROM (SELECT id, text, unnest(urls) AS url FROM posts) WHERE contains(url, 'play.google'))
"""


def weights(posts: str, items: str, min_df: int = 1, n: int = 1) -> str:
    """CTEs from (id, text) sources to unit-length TF-IDF weights ``w(side, id, term, w)``."""
    if n == 1:
        terms = "words AS (SELECT side, id, unnest(t) AS term FROM toks)"
    else:
        parts = " || ' ' || ".join(["term"] + [f"lead(term, {k}) OVER o" for k in range(1, n)])
        terms = f"""
singles AS (SELECT side, id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
grams AS (SELECT side, id, {parts} AS term FROM singles
          WINDOW o AS (PARTITION BY side, id ORDER BY pos)),
words AS (SELECT * FROM grams WHERE term IS NOT NULL)"""
    return f"""
corpus AS (SELECT 'p' AS side, id, text FROM ({posts}) UNION ALL
           SELECT 'i' AS side, id, text FROM ({items})),
toks AS (SELECT side, id, {cleaned('text')} AS t FROM corpus),
{terms},
tf AS (SELECT side, id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT count(*) AS n FROM corpus),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term HAVING count(*) >= {min_df}),
raw AS (SELECT side, id, term, tf * ln((n + 1.0) / (df + 1.0)) AS w FROM tf JOIN stats USING (term), docs),
norm AS (SELECT side, id, sqrt(sum(w * w)) AS len, count(*) AS active FROM raw GROUP BY side, id),
w AS (SELECT side, id, term, w / len AS w, active FROM raw JOIN norm USING (side, id) WHERE len > 0)
"""


def similarities(min_active: int = 0) -> str:
    """CTE ``sims(post_id, item_id, s)`` over ``w``; brute force over shared terms."""
    return f"""
sims AS (SELECT * FROM (
  SELECT p.id AS post_id, i.id AS item_id, round(sum(p.w * i.w), 9) AS s
  FROM w p JOIN w i ON p.term = i.term
  WHERE p.side = 'p' AND i.side = 'i' AND p.active >= {min_active} AND i.active >= {min_active}
  GROUP BY p.id, i.id) WHERE s > 0)
"""


def links(threshold: float) -> str:
    """CTE ``links(post_id, item_id, s)``: the best item of each post above the threshold."""
    return f"""
links AS (SELECT post_id, item_id, s FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY s DESC, item_id) AS rn FROM sims)
  WHERE rn = 1 AND s > {threshold})
"""


def components(posts: str, items: str, k: int, centred: bool, rounds: int = 400) -> str:
    """CTEs up to ``parts(id, c1, .., ck)`` and ``lam(l1, .., lk)``: the rows of the texts' TF-IDF
    matrix in the space of its leading directions, by power iteration with deflation."""
    steps = []
    for c in range(1, k + 1):
        gone = "".join(f" - l{p} * v{p}[i] * list_dot_product(v{p}, v)" for p in range(1, c))
        before = f"f{c - 1}" if c > 1 else "whole"
        held = ", ".join(["m", "q"] + [f"v{p}, l{p}" for p in range(1, c)])
        steps.append(f"""
p{c}(step, v, {held}) AS (
  SELECT 0, list_transform(range(1, len(m) + 1), LAMBDA i: CAST(1 + i % 7 AS DOUBLE)), {held} FROM {before}
  UNION ALL
  SELECT step + 1, list_transform(w, LAMBDA x: x / sqrt(list_dot_product(w, w))), {held}
  FROM (SELECT *, list_transform(range(1, len(m) + 1),
               LAMBDA i: list_dot_product(m[i], v){gone}) AS w FROM p{c}) WHERE step < {rounds}),
f{c} AS (SELECT {held}, v AS v{c},
                list_dot_product(v, list_transform(m, LAMBDA row: list_dot_product(row, v))) AS l{c}
         FROM p{c} WHERE step = {rounds})""")
    coordinates = ", ".join(f"list_dot_product(q[i], v{c}) AS c{c}" for c in range(1, k + 1))
    return f"""{weights(posts, items)},
width AS (SELECT count(*) AS n FROM stats),
named AS (SELECT *, row_number() OVER (ORDER BY side, id) AS i,
                 (SELECT n FROM width) AS n FROM (SELECT side, id, sum(w) AS s FROM raw GROUP BY side, id)),
dots AS (SELECT a.i, b.i AS j, coalesce(d.d, 0) AS d, a.s * b.s / a.n AS mm
         FROM named a CROSS JOIN named b LEFT JOIN (
           SELECT x.side AS xs, x.id AS xi, y.side AS ys, y.id AS yi, sum(x.w * y.w) AS d
           FROM raw x JOIN raw y USING (term) GROUP BY ALL) d
         ON d.xs = a.side AND d.xi = a.id AND d.ys = b.side AND d.yi = b.id),
rows_of AS (SELECT i, list(d{' - mm' if centred else ''} ORDER BY j) AS m, list(d ORDER BY j) AS q FROM dots GROUP BY i),
whole AS (SELECT list(m ORDER BY i) AS m, list(q ORDER BY i) AS q FROM rows_of),
{','.join(steps)},
parts AS (SELECT side || id AS key, {coordinates} FROM named, f{k}),
lam AS (SELECT {', '.join(f'l{c}' for c in range(1, k + 1))}, (SELECT n FROM width) AS n FROM f{k})
"""
