import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexaudit.llm import plane_files, ppm, quality, queries, word_table
from lexaudit.llm.tokens import shingle_hashes, word_hashes
from lexaudit.llm.words import SpacedEncoder

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPLIT, PIECES, ENCODER = word_table.Splitter(BYTE_BPE), word_table.byte_pieces(BYTE_BPE), SpacedEncoder(WORD_BPE)
TEXTS = [
    (0, "The cat sat on the mat.\nThe cat's hat isn't 12,345 big."),
    (1, None),
    (2, ""),
    (3, "été \U0001f600\U0001f468‍\U0001f469 naïve\u0301 ΑΣΣΑΣ İstanbul \u0130 \x1c\x1d a\x0bb\x0cc\x85d\xa0e\u2028f"),
    (4, "a <|endoftext|> b<|startoftext|>  <|endoftext|>\n\n  end   "),
    (5, "word " * 60_000 + "\n" * 300),
    (6, "x" * 5_000 + " " + "y" * 100),
    (7, "The cat sat on the mat.\nThe cat's hat isn't 12,345 big."),
    (None, "no id here"),
    (-(2**63), "the least id of all"),
    (7, "The cat sat on the mat.\nThe cat's hat isn't 12,345 big."),
    (20, "the hat of the cat; the mat of the hat"),
    (21, "\t\r\n tabs\tand\r\nlines \u200b zero  width"),
]
SCHEMA = "doc_id long, text string, ids string, held_out int, chunk int"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, "clash", 3, 4) for d, t in rows], SCHEMA).repartition(3)


@functools.cache
def tokenizer(path):
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


ANY_TEXT = st.text(st.one_of(st.sampled_from(" \n\t\x0b\x0c\x1c\x1f\x85\xa0\u2028\u3000'sdlt9Ab.<|>é́ΣǅKſİ"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ANY_TEXT)
def test_words_are_those_of_the_library(text):
    found, split = tokenizer(BYTE_BPE), SPLIT
    ids = [i for w in split(text.encode()) for i in found.encode(w, add_special_tokens=False).ids]
    assert ids == found.encode(text, add_special_tokens=False).ids
    assert b"".join(PIECES[i] for i in ids).decode("utf-8", "replace") == found.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(ANY_TEXT)
def test_word_encoder_is_the_library(text):
    words = word_table.Blanks(WORD_BPE)(text.encode())
    ids = np.frombuffer(b"".join(ENCODER.ids(words)), "<u4")
    plain = [w for w in words if ENCODER.PLAIN.fullmatch(w.decode())] * 3
    assert ENCODER.ids(plain) == [np.array(tokenizer(WORD_BPE).encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in plain]
    assert ids.tolist() == tokenizer(WORD_BPE).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(ANY_TEXT, max_size=6))
def test_word_and_shingle_hashes(texts):
    data = [x.encode() for x in texts]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", x.lower()) for x in data]
    hashes, first = word_hashes(data)
    assert np.diff(first).tolist() == [len(x) for x in words]
    flat = [w for x in words for w in x]
    assert len(set(hashes.tolist())) == len(set(flat)) and dict(zip(flat, hashes.tolist(), strict=True)) == {w: h for w, h in zip(flat, hashes.tolist(), strict=True)}
    runs = [[tuple(x[i : i + 3]) for i in range(len(x) - 2)] or ([tuple(x)] if x else []) for x in words]
    found, at = shingle_hashes(hashes, first, 3)
    assert np.diff(at).tolist() == [len(x) for x in runs]
    assert len(set(found.tolist())) == len({r for x in runs for r in x})


def brute_digests(rows):
    t, out = tokenizer(BYTE_BPE), []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [10, 8_000_000])
def test_word_table_against_the_library(spark, size):
    got = queries.digested(word_table.decode(word_table.encode(frame(spark), BYTE_BPE, size), BYTE_BPE))
    assert sorted(map(tuple, got.collect()), key=str) == brute_digests(TEXTS)
    assert sorted(map(tuple, queries.digested(word_table.round_trip(frame(spark), BYTE_BPE, size)).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert word_table.encode(frame(spark, []), BYTE_BPE).count() == 0
    assert word_table.round_trip(frame(spark, []), BYTE_BPE).count() == 0


def test_word_table_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op3_bpe_word_table(spark, sf).collect()), key=str) == brute_digests(rows)


def brute_files(rows):
    t, out, start = tokenizer(WORD_BPE), [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("bits", "block", "chunk_bytes"), [(False, 65_536, 8_000_000), (True, 1000, 500), (False, 7, 1)])
def test_plane_files_round_trip(spark, bits, block, chunk_bytes):
    manifest = plane_files.write(frame(spark), WORD_BPE, bits=bits, block=block, chunk_bytes=chunk_bytes)
    got = sorted((tuple(r) for r in plane_files.read(manifest).collect()), key=lambda r: r[1])
    assert got == brute_files(TEXTS)


def test_plane_files_edges(spark, tmp_path):
    assert plane_files.read(plane_files.write(frame(spark, []), WORD_BPE)).count() == 0
    for bits in (False, True):
        for n in (0, 1, 8, 13):
            ids = np.arange(n, dtype=np.uint32) * 98_765
            assert (plane_files.ids_of(plane_files.planes_of(ids, bits), n, bits) == ids).all()
    writer = plane_files.Writer(f"{tmp_path}/x.plane", block=10)
    for d in range(5):
        writer.add(d, np.arange(d * 7, dtype=np.uint32))
    writer.close()
    reader = plane_files.Reader(f"{tmp_path}/x.plane")
    assert reader.read_block(2).tolist() == np.concatenate([np.arange(d * 7) for d in range(5)])[20:30].tolist()
    assert [(d, s, len(x)) for d, s, x in reader.documents()] == [(0, 0, 0), (1, 0, 7), (2, 7, 14), (3, 21, 21), (4, 42, 28)]


def test_plane_files_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op10_plane_files(spark, sf).collect()), key=lambda r: r[1]) == brute_files(rows)


class BrutePpm:
    """The model as its definition says, symbol by symbol."""

    def __init__(self, texts, order=5):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            data = b"\xfe" * order + text + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[i - k : i]][data[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            found = {s: n for s, n in self.seen.get(context[len(context) - k :], {}).items() if s not in excluded}
            if not found:
                continue
            whole = sum(found.values()) + len(found)
            if symbol in found:
                return out * found[symbol] / whole
            out *= len(found) / whole
            excluded |= found.keys()
        return out / (256 - len(excluded))

    def score(self, text):
        data = b"\xfe" * self.order + text + b"\xff"
        return sum(math.log10(self.p(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute_scores(rows, order=5):
    rows = [(d, (x or "").encode()) for d, x in rows]
    train = [x for d, x in rows if not held(d)]
    model, counts = BrutePpm(train, order), Counter()
    for x in train:
        counts.update(re.findall(rb"[^\x20\x09-\x0D]+", x.lower()))
        counts[None] += 1
    n, v, out = sum(counts.values()), len(counts), []
    for d, x in rows:
        words = [*re.findall(rb"[^\x20\x09-\x0D]+", x.lower()), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((d, held(d), len(words), sum(counts[w] > 0 for w in words), n, base, model.score(x)))
    return sorted(out, key=lambda r: str(r[:2]))


def same_scores(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: str(r[:2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for i in (5, 6):
        assert np.allclose([r[i] for r in got], [r[i] for r in want], rtol=1e-5, atol=1e-6)


def test_brute_ppm_is_a_distribution():
    model = BrutePpm([b"abracadabra", b"abba"], 2)
    for context in (b"ab", b"zz", b"ra", b"\xfe\xfe", b"bb"):
        assert abs(sum(model.p(context, s) for s in range(256)) - 1) < 1e-9


@pytest.mark.parametrize("size", [10, 16_000_000])
def test_ppm_against_brute_force(spark, size):
    rows = [r for r in TEXTS if r[0] != 5] + [(5, "word " * 300)]
    assert any(held(d) for d, _ in rows) and not all(held(d) for d, _ in rows)
    same_scores(ppm.score(frame(spark, rows), size).collect(), brute_scores(rows))


def test_ppm_edges(spark):
    assert ppm.score(frame(spark, [])).count() == 0
    only = [(d, "abc") for d in range(60) if held(d)][:2]
    row = ppm.score(frame(spark, only)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (2, 0, 0, 0.0)
    assert abs(row["score"] + 4 * math.log10(256)) < 1e-5


def test_ppm_query_against_brute_force_and_base(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op2_ppm_score(spark, sf).collect()
    same_scores(got, brute_scores(rows))
    sizes = {d: len((x or "").encode()) + 1 for d, x in rows}
    out = [r for r in got if r["held_out"]]
    assert sum(-r["score"] for r in out) / sum(sizes[r["doc_id"]] for r in out) < 0.9  # three bits a byte


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op4_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = [r["predicted"] == labels[r["doc_id"]] for r in got]
    good, bad = ([r["score"] for r in got if labels[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert np.mean(right) > 0.9 and auc > 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(d, int(d % 2 == 0), "x") for d in range(40)] + [(None, 1, "x"), (3, None, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    docs = spark.createDataFrame([(d, ("good words here " * 9) if d % 2 == 0 else "BAD!! STUFF## " * 9, 1) for d in range(40)] + [(50, None, 1), (51, "", 1), (52, "one", 1), (None, "none", 1), (53, "x" * 3_000_000, 1)], "doc_id long, text string, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 45 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert by_id[50]["score"] == by_id[51]["score"]
    assert np.mean([by_id[d]["score"] for d in range(0, 40, 2)]) > np.mean([by_id[d]["score"] for d in range(1, 40, 2)])
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in by_id.items() if d is not None)
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    one = quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert all(r["score"] > 0.5 for r in one)
    assert len(quality.score(docs, quality.fit(docs, labels.limit(0))).collect()) == 45


def test_quality_inputs_are_the_text_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).collect()}
    assert a == b
