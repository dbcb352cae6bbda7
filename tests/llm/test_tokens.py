"""Tokenisers and token counts against a plain library and brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from catalink.llm import bpe, pretokens, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks=pretokens.read_ranks(RANKS))


def test_encoding_equals_the_library(messy):
    rows, docs = messy
    own = library()
    want = Counter()
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.digests(bpe.encode_documents(docs, RANKS, PATTERN)).collect()
    assert Counter(map(tuple, got)) == want


def test_random_strings_appends_and_edits():
    tables = bpe.token_tables(pretokens.read_ranks(RANKS))
    encoder, own, rng = bpe.PrefixEncoder(tables), library(), random.Random(2)
    letters = ["a", "b", "the", "on", "ing", "é", "ß", "漢", "й", "и"]
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20)))
        assert encoder.encode(word.encode()) == own.encode_ordinary(word)
        more = rng.choice(letters)
        assert encoder.append(word.encode(), more.encode()) == own.encode_ordinary(word + more)
    assert encoder.encode(b"") == []


def test_long_pretokens_take_memory_by_their_length():
    tables = bpe.token_tables(pretokens.read_ranks(RANKS))
    encoder, own, rng = bpe.PrefixEncoder(tables), library(), random.Random(6)
    parts = ["a", "the", "on", "ing", "er", "é", "漢", "z", "q", "lich"]
    text = "".join(rng.choice(parts) for _ in range(9_000))
    tracemalloc.start()
    got = encoder.encode(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == own.encode_ordinary(text) and peak < 40e6
    for more in ("er", "q", "漢ing"):
        text += more
        assert encoder.append(text[:-len(more)].encode(), more.encode()) == own.encode_ordinary(text)
    edited = text[:5000] + "zq" + text[5003:]
    for x in (edited, text[:4000], text[:3999] + "zz", text):
        assert encoder.encode(x.encode()) == own.encode_ordinary(x)


def test_texts_with_pretokens_of_100_kb(spark):
    rng = random.Random(7)
    base64 = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFG") for _ in range(100_000))
    texts = [base64, "x " + "".join(rng.choice("0123456789") for _ in range(100_000)) + " y",
             "a" + " " * 100_000 + "b", "short words", base64[:99_000] + " ende", "\n" * 100_000]
    own = library()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, PATTERN).collect()}
    for i, x in enumerate(texts):
        assert list(got[i].ids) == own.encode_ordinary(x) and bytes(got[i].decoded) == x.encode()


def test_pieces_have_the_pretokens_of_the_text():
    split, rng = pretokens.splitter(PATTERN), random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", " ", "a", "B", "7", "'s", "!", "é"])
                       for _ in range(rng.randint(0, 12)))
        assert [w for p in pretokens.pieces(text) for w in split(p)] == split(text)


def test_token_counts(messy):
    rows, docs = messy
    ranks = pretokens.read_ranks(RANKS)
    scores, split = token_counts.zipf_scores(ranks), pretokens.splitter(PATTERN)
    longest = max(map(len, ranks))

    def tokens(word):
        best = [(0, 0)]
        for i in range(1, len(word) + 1):
            best.append(max((best[j][0] + scores[word[j:i]], best[j][1] - 1)
                            for j in range(max(0, i - longest), i) if word[j:i] in scores))
        return -best[-1][1]

    want = Counter()
    for i, t, _ in rows:
        words = split(t or "")
        want[i, len((t or "").encode()), len(words), sum(tokens(w.encode()) for w in words)] += 1
    got = token_counts.count_tokens(docs, RANKS, PATTERN).collect()
    assert Counter(map(tuple, got)) == want


def test_empty_tables(empty):
    assert bpe.encode_documents(empty, RANKS, PATTERN).count() == 0
    assert token_counts.count_tokens(empty, RANKS, PATTERN).count() == 0


def test_a_very_long_pretoken_takes_little_memory():
    scores = token_counts.zipf_scores(pretokens.read_ranks(RANKS))
    rng = random.Random(4)
    parts = ["a", "the", "on", "ing", "er", "é", "漢", "z", "q", "lich"]
    trie, plain = token_counts.Trie(scores), token_counts.Trie(scores)
    word = "".join(rng.choice(parts) for _ in range(100_000)).encode()
    tracemalloc.start()
    assert trie.insert(word) > 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(trie.score) <= token_counts.LONG + 1

    def best(word):
        held = [(0, 0)]
        for i in range(1, len(word) + 1):
            held.append(max((held[i - n][0] + scores[word[i - n:i]], held[i - n][1] - 1)
                            for n in range(1, min(i, plain.reach) + 1) if word[i - n:i] in scores))
        return -held[-1][1]

    for size in (10, 63, 64, 65, 66, 200, 900):
        some = word[1000:1000 + size]
        assert plain.insert(some) == best(some)


def test_sorted_pre_tokens_equal_the_library():
    own, rng = library(), random.Random(4)
    words = {"".join(rng.choices("abeinrst é中'1", k=rng.randint(1, 90))) for _ in range(400)}
    encoder = bpe.PrefixEncoder(bpe.token_tables(pretokens.read_ranks(RANKS)))
    ordered = sorted(w.encode() for w in words)
    got = list(encoder.encode_sorted(ordered))
    assert got == [own._encode_single_piece(w) for w in ordered]


def test_cut_texts_equal_the_library_and_a_worker_keeps_its_encoder():
    own, rng = library(), random.Random(9)
    parts = [" ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "The", "B", "7", "12", "'",
             "'s", "!", ".", "é", "ß", "漢", "й", "\x7f", "🙂", "wort", "x" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(6000)]
    encoder = bpe.TextEncoder(bpe.token_tables(pretokens.read_ranks(RANKS)), PATTERN)
    for at in range(0, len(texts), 2000):
        some = texts[at:at + 2000]
        ids, bounds = encoder.encode(pa.array([t.encode() for t in some]))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == list(map(own.encode_ordinary, some))
        assert encoder.decode(ids, bounds).to_pylist() == [t.encode() for t in some]
    assert bpe.PATTERN == PATTERN
    other = bpe.TextEncoder(encoder.tables, r"\w+|\W")
    ids, _ = other.encode(pa.array([b"wort wort,", b""]))
    assert other.tokens.take(pa.array(ids)).to_pylist() == own.decode_tokens_bytes(
        [i for w in ("wort", " ", "wort", ",") for i in own.encode_ordinary(w)])


def test_new_pre_tokens_are_encoded_together():
    """In less time than one by one, as encode() still goes through them."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abdeiklmnoprstu", k=rng.randint(4, 14))).encode() for _ in range(30_000)})
    tables = bpe.token_tables(pretokens.read_ranks(RANKS))
    encoder, plain = bpe.PrefixEncoder(tables), bpe.PrefixEncoder(tables)
    list(encoder.encode_sorted(words[:1000]))
    start = time.process_time()
    ids, counts = encoder.encode_together(words)
    together = time.process_time() - start
    start = time.process_time()
    assert np.concatenate([plain.encode(w) for w in words]).tolist() == ids.tolist()
    assert 1.5 * together < time.process_time() - start and counts.sum() == len(ids)
