"""Decontamination, classifiers, language model, shards and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.llm import decontaminate, fm_index, language_id, language_model
from catalink.llm import blocks as packing
from catalink.llm import quality, sharding
from catalink.llm.folds import fold

from tests.llm.conftest import messy_frame, prose
from tests.llm.test_dedup import LOWER, WORDS, similarity_truth
from tests.llm.test_tokens import library


def words(text):
    return WORDS.findall((text or "").encode().translate(LOWER))


# ---------------------------------------------------------------- decontamination

def test_fm_index_finds_and_locates_every_occurrence():
    rng = np.random.default_rng(0)
    for trial in range(150):
        size, symbols = int(rng.integers(1, 100)), int(rng.integers(2, 6))
        text = rng.integers(0, symbols, size)
        text[-1] = 0
        text = np.tile(text, 1 + trial % 3)
        index = fm_index.FMIndex(text, symbols)
        phrases = [tuple(rng.integers(1, symbols, int(rng.integers(1, 5)))) for _ in range(20)]
        table = np.zeros((20, 4), np.int64)
        for row, x in zip(table, phrases):
            row[:len(x)] = x
        low, high = index.search(table, np.array([len(x) for x in phrases]))
        for k, x in enumerate(phrases):
            want = [i for i in range(len(text)) if tuple(text[i:i + len(x)]) == x]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def benchmark_rows(rows):
    own = [words(t) for _, t, _ in rows]
    text = [b" ".join(w).decode() for w in own]
    return [(1, " ".join(text[2].split()[1:20])), (10, " ".join(text[5].split()[3:13]).upper()),
            (2, "12 34"), (3, ""), (4, None), (5, "nothing of this kind occurs in any of the texts"),
            (6, "аб"), (7, " ".join(text[7].split()[:9])), (None, " ".join(text[9].split()[:30])),
            (1, " ".join(text[2].split()[1:20])), (8, "abc abc")]


def contamination_truth(rows, bench):
    windows = defaultdict(set)
    for name, text in bench:
        w = words(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[i:i + 10])].add("" if name is None else str(name))
    lengths = {len(x) for x in windows}
    for i, text, _ in rows:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        yield (i, len(w), len(hit), len(items),
               hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_contamination(spark, messy, block_bytes):
    rows, docs = messy
    bench = benchmark_rows(rows)
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contamination(docs, table, block_bytes=block_bytes)
    got = Counter(map(tuple, decontaminate.summary(found).collect()))
    want = Counter(contamination_truth(rows, bench))
    assert got == want and sum(x[-1] for x in want) > 5
    clean = decontaminate.clean_documents(docs, table, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(x[0] for x in want.elements() if not x[-1])


def test_spans_are_cut_out_of_a_text():
    text = "One, two  three! Four five."
    assert decontaminate.without_spans(text, [(1, 3)]) == "One, ! Four five."
    assert decontaminate.without_spans(None, [(0, 1)]) is None


def test_contamination_of_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    found = decontaminate.summary(decontaminate.contamination(messy[1], none)).collect()
    assert len(found) == len(messy[0]) and not any(r.contaminated for r in found)
    assert decontaminate.clean_documents(messy[1], none).count() == len(messy[0])


# ---------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(["en", "fr"])
        text, good = prose(rng, lang, rng.randint(8, 80)), rng.random() < 0.7
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "%%"]) for w in text.split())
        rows.append((i, text, lang))
        labels.append((i, int(good)))
    return rows, labels, messy_frame(spark, rows), spark.createDataFrame(
        labels + [(3, None), (9999, 1)], "doc_id long, quality int")


def held(i, n, k):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == k


def test_quality_is_learned_from_other_folds(labelled):
    rows, labels, docs, table = labelled
    got = {r.doc_id: r for r in quality.score_quality(docs, table).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == held(i, 5, 0) for i, _, _ in rows)
    test = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_of_messy_rows_and_without_labels(spark, messy, labelled, empty):
    rows, docs = messy
    got = quality.score_quality(docs, labelled[3]).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    none = quality.score_quality(docs, labelled[3].limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(empty, labelled[3]).count() == 0


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.random((400, len(quality.STATISTICS)))
    forest = quality.grow(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float))
    total = np.full(5, forest.prior)
    for i in range(5):
        for node in forest.roots:
            for _ in range(quality.DEPTH):
                right = x[i, forest.feature[node]] > forest.limit[node]
                node = forest.right[node] if right else forest.left[node]
            total[i] += forest.value[node]
    assert np.allclose(forest.scores(x[:5]), 1 / (1 + np.exp(-total)))
    assert ((forest.scores(x) > 0.5) == ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3))).mean() > 0.95


def test_languages_of_the_held_out_fold(labelled):
    rows, _, docs, _ = labelled
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    test = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) > 0.98
    assert np.mean([r.accepted for r in got.values()]) > 0.99


def test_languages_of_messy_rows(messy, empty):
    rows, docs = messy
    got = defaultdict(list)
    for r in language_id.identify(docs).collect():
        got[r.doc_id].append(r)
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
    assert sum(map(len, got.values())) == len(rows)
    for i in (200, 201, 202, 203, 204):
        assert [(r.lang_pred, r.score, r.accepted) for r in got[i]] == [("und", 0.0, False)]
    model = language_id.fit_documents(docs)
    assert not model.predict("漢字漢字漢字 漢字漢字")[2]  # no language that was learned
    assert model.predict("x" * 2_500_000)[0] in model.languages
    assert language_id.identify(empty).count() == 0
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unknown).collect()} == {"und"}


def test_no_language_is_dropped(spark):
    rows = [(k * 10 + i, f"q{k}x q{k}y q{k}z " * 3, f"l{k:03}") for k in range(205)
            for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    sample = language_id.training_sample(docs, "doc_id", "text", "lang", 4, 9).collect()
    assert Counter(r.lang for r in sample) == Counter(x for _, _, x in rows)


def test_factored_table_scores_like_the_whole_one():
    rng = random.Random(14)
    texts = [(" ".join(f"{chr(97 + k)}{rng.choice('aeiou')}{chr(98 + k)}" for _ in range(20)),
              f"l{k:02}") for k in range(20) for _ in range(6)]
    model = language_id.fit([t for t, _ in texts], [x for _, x in texts])
    assert model.table.shape[1] == language_id.WIDTH + 1 and len(model.languages) == 20
    whole = language_id.Model(model.languages, np.hstack(
        [model.table[:, :-1] @ model.out, model.table[:, -1:]]), model.bias)
    for t, x in texts:
        assert np.allclose(model.scores(t)[0], whole.scores(t)[0], atol=1e-4)
    assert np.mean([model.predict(t)[0] == x for t, x in texts]) > 0.9


@pytest.fixture(scope="module")
def two_languages():
    rng = random.Random(11)
    rows = [(prose(rng, lang, rng.randint(5, 60)), lang) for lang in ("en", "fr") * 700]
    return language_id.fit([t for t, _ in rows], [x for _, x in rows])


@pytest.mark.parametrize("text", [
    "Questa mattina il treno per la montagna era in ritardo e molti aspettavano sul binario.",
    "Aamulla juna vuorille oli myöhässä ja monet matkustajat odottivat laiturilla.",
    "Bu sabah dağlara giden tren gecikti ve birçok yolcu peronda bekliyordu.",
    "Dziś rano pociąg w góry był opóźniony i wielu podróżnych czekało na peronie."])
def test_unlearned_languages_of_the_same_script_are_rejected(two_languages, text):
    assert not two_languages.predict(text)[2]
    assert not two_languages.predict(text * 30)[2]


def test_texts_of_mostly_known_ngrams_are_rejected(two_languages):
    rng = random.Random(12)
    other = " ".join("".join(rng.choice("the on er re in th ing ou sch zu".split())
                             for _ in range(3))
                     for _ in range(80))
    known = two_languages.scores(other)[1]
    assert 0.5 < known < 0.95 and not two_languages.predict(other)[2]


def test_few_texts_of_learned_languages_are_rejected(two_languages):
    rng = random.Random(13)
    texts = [(prose(rng, lang, n), lang) for lang in ("en", "fr") for n in range(2, 152)]
    got = [two_languages.predict(t) for t, _ in texts]
    assert np.mean([a for _, _, a in got]) > 0.98
    # lengths with few texts are calibrated together
    sizes = np.array([1] * 3 + [5] * 1200 + [70] * 2)
    values = np.tile(np.linspace(0.5, 1, len(sizes))[:, None], 2)
    assert (language_id.bounds_by_length(sizes, values, sizes > 0) == values[1]).all()


# ---------------------------------------------------------------- language model

def lm_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)) + [b"\0end"]


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_language_model(messy, monkeypatch, block_bytes):
    monkeypatch.setattr(packing, "BLOCK_BYTES", block_bytes)
    rows, docs = messy
    train = Counter(w for i, t, _ in rows if not held(i, 7, 2) for w in lm_tokens(t))
    total, kinds = sum(train.values()), len(train)
    want = Counter()
    for i, t, _ in rows:
        w = lm_tokens(t)
        base = sum(math.log10((train[x] + 1) / (total + kinds + 1)) for x in w)
        want[i, held(i, 7, 2), len(w), sum(train[x] > 0 for x in w), total, round(base, 4)] += 1
    got = language_model.score_documents(docs).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    test = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_all_tokens_and_the_unseen_event_share_one(messy):
    rows, docs = messy
    held_ = packing.packed(docs, "doc_id", "text", fold("doc_id", 7) == 2)
    words_ = language_model.Vocabulary(
        language_model.count_tokens(held_, packing.range_bits(held_)))
    train = Counter(w for i, t, _ in rows if not held(i, 7, 2) for w in lm_tokens(t))
    counts = np.sort(np.array(list(train.values())))[::-1]
    assert sorted(words_.counts.tolist(), reverse=True) == counts[:language_model.FREQUENT].tolist()
    rest = counts[language_model.FREQUENT:]
    mass = np.bincount(language_model.level(rest), weights=rest + 1,
                       minlength=language_model.LEVELS)
    mass[0] += 1
    used = mass > 0
    assert np.allclose(mass[used] / words_.shares[used], 1)


def test_language_model_without_training_rows(spark, empty):
    assert language_model.score_documents(empty).count() == 0
    alone = next(i for i in range(100) if held(i, 7, 2))
    docs = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    row = language_model.score_documents(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


# ---------------------------------------------------------------- shards

def smallest(weights, shards):
    """Least largest sum of a contiguous cut, by trying every sum."""
    ends = np.concatenate([[0], np.cumsum(weights)])
    for capacity in sorted({int(b - a) for a in ends for b in ends if b > a}):
        at = 0
        for _ in range(shards):
            at = int(ends[np.searchsorted(ends, at + capacity, side="right") - 1])
        if at == ends[-1]:
            return capacity


@pytest.mark.parametrize("first", [1, 4])
def test_capacity_is_the_optimum(spark, monkeypatch, first):
    monkeypatch.setattr(sharding, "FIRST", first)
    rng = random.Random(first)
    for shards in (1, 3, 7):
        groups = sorted((hashlib.sha256(str(rng.random()).encode()).hexdigest(),
                         rng.choice([1, 2, 50, 400])) for _ in range(90))
        table = spark.createDataFrame(groups, "digest string, weight long")
        cuts, capacity = sharding.minimax_cuts(table, shards)
        assert capacity == smallest([w for _, w in groups], shards)
        sums = Counter()
        for d, w in groups:
            sums[sum(d >= c for c in cuts)] += w
        assert max(sums.values()) <= capacity and len(cuts) < shards


def test_shards_of_messy_rows(messy, empty):
    rows, docs = messy
    got = sharding.contiguous_shards(docs, 5).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, shard = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(5))
    assert sharding.contiguous_shards(empty).count() == 0


# ---------------------------------------------------------------- pipeline and queries

@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, docs = messy
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark_rows(rows), "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_pipeline_equals_its_stages_by_brute_force(spark, messy, folder):
    import corpus_pipeline

    rows = messy[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = {(r.doc_id, r.text) for r in language_id.accepted_documents(docs).collect()}
    # all prose is kept; a text of one strange word may be of no language that was learned
    assert {(i, t) for i, t, _ in rows if re.search(r"[a-z]{3}", t or "") and "abc" not in t} <= told
    kept = [(i, t, x) for i, t, x in rows if (i, t) in told]
    best = {}
    for i, t, x in kept:
        best[t] = (i, t, x) if t not in best or (best[t][0] is None or (
            i is not None and i > best[t][0])) else best[t]
    kept = list(best.values())
    kept = [row for row, truth in zip(kept, similarity_truth(kept)) if truth[0] == truth[1]]
    bad = [x[-1] for x in contamination_truth(kept, benchmark_rows(rows))]
    own = library()
    want = Counter((i, tuple(own.encode_ordinary(t))) for (i, t, _), b in zip(kept, bad) if not b)
    got = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert any(bad) and 0 < len(want) < len(rows)


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_exact_dedup"])
def test_query_equals_sql(spark, name):
    import check

    from catalink.llm.queries import QUERIES, SQL
    from tests.llm.conftest import SF

    got = QUERIES[name](spark, SF).toPandas()
    assert check.compare(got, check.tables(SF).execute(SQL[name]).df()) == "ok"


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


@pytest.mark.parametrize("n", range(1, 11))
def test_query_gives_one_row_per_document(spark, n):
    from catalink.llm.queries import QUERIES
    from tests.llm.conftest import SF

    name = next(x for x in QUERIES if x.startswith(f"op{n}_"))
    got = QUERIES[name](spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert got.select("doc_id").exceptAll(want).isEmpty() and got.count() == want.count()


def test_shared_values_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = language_id.fit(["the one", "der eine"] * 20, ["en", "de"] * 20)
    forest = quality.grow(np.zeros((4, len(quality.STATISTICS))), np.array([0.0, 1, 0, 1]))
    windows = decontaminate.Windows([("1", "a b c")], 2)
    (tmp_path / "v").write_bytes(cloudpickle.dumps((model, forest, windows)))
    code = ("import pickle; m, f, w = pickle.load(open('v', 'rb')); "
            "print(m.predict('the')[0], len(w.items), f.scores(f.value.reshape(1, -1)).shape)")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin"}, timeout=60)
    assert run.stdout.split()[:2] == ["en", "2"], run.stderr


def test_a_step_makes_sums_for_the_rows_it_meets():
    import tracemalloc

    name, rows = "class_rows", np.array([[1, 5, 1], [5, 9, 40]], np.uint32)
    tables = {name: np.zeros((1 << language_model.ROW_BITS, language_model.CLASSES), np.float32)}
    trainer = language_model.Trainer(tables)
    slope = np.arange(3 * language_model.CLASSES, dtype=np.float32).reshape(3, -1) + 1
    tracemalloc.start()
    trainer.step(name, rows, slope)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20
    want = {1: slope[0] + slope[2], 5: slope[1] + slope[0], 9: slope[1], 40: slope[2]}
    assert set(np.flatnonzero(trainer.w[name].any(axis=1))) == set(want)
    for row, g in want.items():
        assert np.allclose(trainer.w[name][row], -language_model.STEP * g / np.sqrt(1 + g * g))
    assert {r: int(n) for r, n in enumerate(trainer.met[name]) if n} == {1: 2, 5: 2, 9: 1, 40: 1}
