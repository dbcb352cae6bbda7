"""Fill-in-middle, token files and importance resampling against brute force and round trips."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalink.llm import fill_middle, importance, planes, pretokens, token_files

MODEL = public_tokenizers.path("word_bpe_49k.json")
NAMES = ["`__id`", "a.b", "text", "row", "tie", "part", "h0", "form", "n", "output", "bucket", "x y"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(docs):
    """The same rows under dotted names, with extra columns that have the operators' own names."""
    out = docs.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"))
    for name in NAMES:
        out = out.withColumn(name, F.lit(None).cast("string"))
    return out.withColumn("doc_id", F.lit("z")).withColumn("weight", F.lit("z"))


# ---------------------------------------------------------------- fill-in-middle

def plain_fill(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(3)
    marks = ["<", "<P", "<S", "<M", ">", "P>", "S>", "M>", "a", "é", "漢", "🙂", " ", "\n", "ab", "<M>"]
    return [(1000 + i, "".join(rng.choice(marks[:-1]) for _ in range(rng.randint(1, 40))))
            for i in range(300)] + [(2000, "x <S> y"), (2001, "<"), (2002, "q" * 5_000_000)]


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_fill_in_middle_equals_brute_force_and_restores(spark, messy, step, monkeypatch):
    monkeypatch.setattr(fill_middle, "STEP", step)
    rows, docs = messy
    odd = odd_texts() if step > 7 else odd_texts()[:-1]
    rows = [(i, t) for i, t, _ in rows] + odd
    docs = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(odd, "doc_id long, text string"))
    got = fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()
    want = [plain_fill(i, t) for i, t in rows]
    assert Counter((*r[:6], r.output_sha256, r.restored, r.restored_sha256) for r in got) == Counter(
        (*w, sha(w[-1]), t or "", sha(t or "")) for w, (_, t) in zip(want, rows))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_ignores_other_columns(spark, messy, empty):
    _, docs = messy
    plain = fill_middle.fill_in_middle(docs).collect()
    other = fill_middle.fill_in_middle(clashing(docs), "the.id", "the.text")
    assert Counter(map(tuple, plain)) == Counter(map(tuple, other.collect()))
    again = other.withColumns({"restored": F.lit(1), "__id": F.lit(2), "text": F.lit(3)})
    assert fill_middle.restore(again).count() == len(plain)
    assert fill_middle.restore(fill_middle.fill_in_middle(empty)).collect() == []
    none = spark.createDataFrame([(None, None)], "output string, form string")
    assert fill_middle.restore(none).first().restored == ""


def test_cutting_splits_descriptors_and_permutations_invert():
    table = fill_middle.PieceTable.of(b"abcdef")
    for place in (6, 2, 0):
        table.cut(place)
    assert [e - s for _, s, e in table.pieces] == [0, 2, 4, 0] and table.written() == b"abcdef"
    order = (3, 1, 0, 2)
    back = table.arranged(order).arranged(fill_middle.inverse(order))
    assert back.pieces == table.pieces and back.sha256() == sha("abcdef")
    with pytest.raises(ValueError):
        table.cut(7)


# ---------------------------------------------------------------- files of planes

@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("sizes", [[], [1], [5, 0, 70_000], [65_536, 65_536], [200_001]])
def test_planes_round_trip(bits, sizes):
    rng = np.random.default_rng(len(sizes))
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, (4, 8), bits)
    numbers = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in sizes]
    for part in numbers:
        writer.append(0, part)
        writer.append(1, part.astype(np.uint64) << np.uint64(20))
    assert writer.close() == len(out.getvalue())
    want = np.concatenate([*numbers, np.zeros(0, np.uint32)])
    reader = planes.PlaneReader(out, len(out.getvalue()))
    assert reader.count(0) == len(want) and np.array_equal(reader.read(0), want)
    assert np.array_equal(reader.read(1), want.astype(np.uint64) << np.uint64(20))
    for start, stop in ((0, 1), (65_530, 65_540), (100, 100), (len(want) - 1, len(want) + 9)):
        assert np.array_equal(reader.read(0, start, stop), want[max(0, start):stop])


def test_a_range_reads_only_its_chunks():
    class Counting(io.BytesIO):
        held = 0

        def read(self, n=-1):
            self.held += n
            return super().read(n)

    out = Counting()
    writer = planes.PlaneWriter(out, (4,))
    writer.append(0, np.random.default_rng(1).integers(0, 2**32, 40 * planes.BLOCK, dtype=np.uint32))
    size = writer.close()
    reader = planes.PlaneReader(out, size)
    out.held = 0
    assert len(reader.read(0, 5 * planes.BLOCK + 3, 5 * planes.BLOCK + 30)) == 27
    assert out.held < size / 30


def test_damaged_files_are_errors():
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, (4,))
    writer.append(0, np.arange(1000, dtype=np.uint32))
    size = writer.close()
    data = out.getvalue()
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(data[:-3]), size - 3)
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(data[:-40] + b"\x07" + data[-39:]), size)


# ---------------------------------------------------------------- token files

def library():
    own = Tokenizer.from_file(MODEL)
    own.encode_special_tokens = True
    return own


def test_pieces_encode_as_whole_texts():
    rng, own = random.Random(8), library()
    parts = ["a", "Don't", "'s", "'S", "'", "'ll", "''t", "it's", ".", "!'s", "12", "3x", "x3", " ",
             "  ", "\n", "\t", "é", "é", "́", "≠", "漢字", "İ", "Σ", " ", " ",
             "\x1c", "\x00", "K", "<|endoftext|>", "ﬁ", "½", "🙂", "-", "_", "\x85", "и", "ab"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    import pyarrow as pa

    with open(MODEL, encoding="utf-8") as model:
        encoder = token_files.PieceEncoder(model.read())
    for at in range(0, len(texts), 1500):
        some = texts[at:at + 1500]
        ids, lengths = encoder.encode(pa.array([t.encode() for t in some], pa.binary()))
        want = [own.encode(t, add_special_tokens=False).ids for t in some]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def by_library(rows):
    own, start, out = library(), 0, []
    key = lambda r: (r[0] is None, r[0] or 0)
    for i, t in sorted(rows, key=key):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_hold_all_documents_in_order(spark, messy, bits):
    rows, docs = messy
    docs = docs.unionByName(docs.where("doc_id = 4").limit(1), allowMissingColumns=True)
    rows = [(i, t) for i, t, _ in rows] + [(4, docs.where("doc_id = 4").first().text)]
    files = token_files.write_ids(docs, MODEL, 1, bits=bits, part_bytes=20_000, file_ids=3_000)
    assert files.count() > 8
    documents = token_files.read_documents(files)
    got = token_files.digests(documents).collect()
    want = by_library(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == [w[0] for w in want]
    whole = {r.start: np.frombuffer(r.ids, "<u4") for r in documents.collect()}
    some = token_files.read_range(files, got[3].start, got[9].start)
    assert np.array_equal(some, np.concatenate([whole[r.start] for r in got[3:9]]))


def test_token_files_of_no_or_odd_tables(spark, messy, empty):
    assert token_files.read_documents(token_files.write_ids(empty, MODEL, 1)).collect() == []
    _, docs = messy
    files = token_files.write_ids(clashing(docs), MODEL, 1, id_col="the.id", text_col="the.text")
    assert token_files.read_documents(files).count() == docs.count()
    with pytest.raises(ValueError):
        token_files.write_ids(docs, MODEL, 1, id_col="text")
    none = spark.createDataFrame([(None, None)] * 3, "doc_id int, text string")
    rows = token_files.read_documents(token_files.write_ids(none, MODEL, 1)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [(None, k, 1) for k in range(3)]


def test_repeated_ids_do_not_meet_in_one_range(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"),
                                             F.lit("the same words " * 20).alias("text"))
    files = token_files.write_ids(docs, MODEL, 1, part_bytes=60_000)
    assert files.agg(F.max("n_docs")).first()[0] < 1200
    assert token_files.read_documents(files).count() == 4000


# ---------------------------------------------------------------- importance resampling

def plain_resample(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def words(t):
        return pattern.findall((t or "").translate(lower))

    def features(w):
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets
                for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    own = Counter(b for _, t in rows for b in features(words(t)))
    aim = Counter(b for t in target for b in features(words(t)))
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
            for b in own}
    scored = []
    for i, t in rows:
        w = words(t)
        f = features(w)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, len(f), weight, weight + math.floor(
            -1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [
        (*r[:4], None) for r in scored if not r[4]]


@pytest.mark.parametrize("most,percent", [(1, 10), (2, 50), (3, 100)])
def test_resampling_equals_brute_force(spark, messy, most, percent):
    rows, docs = messy
    target = [rows[3][1], rows[8][1], None, "", "Ab é 12"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, frame, most=most, percent=percent, least=5, buckets=700)
    want = plain_resample([(i, t) for i, t, _ in rows], target, most, 700, percent, 5)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_resampling_of_odd_tables(spark, messy, empty):
    _, docs = messy
    target = docs.select("text").limit(5)
    plain = importance.resample(docs, target).collect()
    other = importance.resample(clashing(docs), target, "the.id", "the.text").collect()
    assert Counter(map(tuple, plain)) == Counter(map(tuple, other))
    assert importance.resample(empty, target).collect() == []
    assert importance.resample(docs, empty).count() == len(plain)


def test_crc_matrices_equal_the_library(monkeypatch):
    monkeypatch.setattr(importance, "CELLS", 100)
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(0, 140), [128, 192, 1000, 64, 63, 65]])
    starts = rng.integers(0, 4000, len(lengths))
    got = importance.crc32_rows(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]


def test_very_long_features_and_texts(spark):
    rows = [(1, "q" * 3_000_000 + " " + "ab " * 300_000), (2, "ab " * 50), (3, "q" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("ab ab",)], "text string")
    got = importance.resample(docs, target, percent=50).collect()
    assert Counter(map(tuple, got)) == Counter(plain_resample(rows, ["ab ab"], percent=50))


def test_encoding_holds_little_beside_its_slice():
    import tracemalloc

    import pyarrow as pa

    from catalink.llm.textbytes import byte_slices

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(500)]
    texts = pa.array([" ".join(rng.choices(words, k=2000)).encode() for _ in range(600)], pa.binary())
    batch = pa.record_batch([pa.array(range(600)), texts], ["doc_id", "text"])
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as model:
        encoder = token_files.PieceEncoder(model.read())
    tracemalloc.start()
    for piece in byte_slices([batch], token_files.SLICE_BYTES):
        encoder.encode(piece.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def test_a_worker_keeps_its_encoder(spark):
    """Each new library left some megabytes behind, over a worker's tasks more than its share."""
    held = pretokens.shared(spark, token_files.PieceEncoder(open(MODEL, encoding="utf-8").read()))

    def one(rows):
        encoder = held.kept
        encoder.tasks = getattr(encoder, "tasks", 0) + 1
        yield encoder.tasks, len(encoder.encode(token_files.pa.array([b"some words"]))[0])

    found = spark.sparkContext.parallelize(range(40), 40).mapPartitions(one).collect()
    assert max(tasks for tasks, _ in found) > 1 and {n for _, n in found} == {2}
