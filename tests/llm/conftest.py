import os
import random
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, "
          "size long, shard int, node binary, block long, score double, item_id string")
SYLLABLES = {"en": "the on er an re in th ing ou wh".split(),
             "fr": "que eau é les oi ment aux ç pa elle".split()}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def prose(rng, lang, n):
    return " ".join(word(rng, lang) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def messy_rows():
    """Copies, near copies, shared passages, repeated rows, nulls, a very long text, odd bytes."""
    rng = random.Random(5)
    texts = [(prose(rng, lang, rng.randint(3, 160)), lang) for lang in ("en", "fr") * 20]
    passage = prose(rng, "en", 70)
    for i in (2, 5, 8):
        texts.append((texts[i][0] + " " + passage + " " + prose(rng, "en", 30), "en"))
    texts += [texts[0]] * 5 + [texts[4]] * 3
    for i in (10, 11, 12):
        near = texts[i][0].split(" ")
        near[len(near) // 2:len(near) // 2 + 1] = [word(rng, "en")]
        texts.append((" ".join(near), texts[i][1]))
    texts.append((prose(rng, "en", 40_000), "en"))
    texts.append(("abc " * 400, "en"))
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    rows += [(200, None, "en"), (201, "", None), (202, None, None), (None, texts[1][0], "en"),
             (None, "lonely words here", "en"), (203, "   \n\t ", "en"), (204, "12 34 !!", "en"),
             (207, None, "en"), (207, "", "en"),
             (205, "漢字 и слова 🙂\x00\x01 é x", None), (206, "Ab  aB\r\n\r\n  ab 's 'S", "en")]
    rows += [rows[3], rows[3], (3, "another text of the same id", "en")]
    return rows


def messy_frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, "s", 1, "d", 1, 1, b"n", 1, 0.5, "x") for i, t, lang in rows],
        SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def messy(spark):
    rows = messy_rows()
    return rows, messy_frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
