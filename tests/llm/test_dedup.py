import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import exact_dedup, fuse_filter, near_dedup, queries

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", 7),
    (2, "alpha beta gamma delta epsilon zeta eta theta", 8),
    (3, None, 9),
    (4, "", 1),
    (5, "one two", 2),
    (6, "ONE  two", 3),
    (7, "word " * 300_000, 4),
    (8, "\U0001f600 été x", 5),
    (None, "alpha beta gamma delta epsilon zeta eta theta", 6),
    (9, "one two", 6),
    (9, "one two", 6),
]
SCHEMA = "doc_id long, text string, component_id long"


def brute_components(rows, size=5, percent=85):
    sets = {}
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        sets[doc] = frozenset(runs)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    index = {}
    for doc, own in sets.items():
        for s in own:
            index.setdefault(s, []).append(doc)
    seen = set()
    for doc, own in sets.items():
        near = {o for s in own for o in index[s] if o < doc}
        for o in near:
            both = len(own & sets[o])
            if (o, doc) not in seen and 100 * both >= percent * (len(own) + len(sets[o]) - both):
                a, b = sorted((root(o), root(doc)))
                label[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def brute_groups(rows):
    out = []
    for doc, text in rows:
        same = [d for d, t in rows if (t or "") == (text or "")]
        known = [d for d in same if d is not None]
        keep = max(known) if known else None
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_fuse_filter_passes_every_key_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, np.uint64)
    made = fuse_filter.build(np.concatenate([keys, keys[:5]]))
    assert fuse_filter.passes(made, keys).all()
    assert fuse_filter.passes(made, rng.integers(0, 2**64, 20_000, np.uint64)).mean() < 0.002
    if n >= 1000:
        assert len(made) < 4 * n


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_against_brute_force(spark, weak):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    digest = (lambda t: F.length(t).cast("string").substr(1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.deduplicate(docs, F.col("doc_id") % 2 == 0, digest=digest)
    rows = [tuple(r) for r in got.collect()]
    want = brute_groups([r[:2] for r in ROWS])
    if weak:
        rows, want = sorted((r[:4] for r in rows), key=str), sorted((r[:4] for r in want), key=str)
    assert sorted(rows, key=str) == want


def test_exact_dedup_of_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i % 3}", "x", 1, True, 5, b"y") for i in range(9)], "doc_id long, text string, digest string, bucket int, old boolean, n long, key binary")
    for buckets in (None, 3):
        got = sorted(tuple(r) for r in exact_dedup.deduplicate(docs, F.col("doc_id") < 5, buckets).collect())
        assert got == sorted((i, 6 + i % 3, 3, i > 5, hashlib.sha256(f"t{i % 3}".encode()).hexdigest()) for i in range(9))


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA), F.col("doc_id") > 0).count() == 0


def test_near_dedup_edges(spark):
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(ROWS[:8] + ROWS[9:], SCHEMA)).collect()}
    assert rows[3]["n_shingles"] == 0 and rows[3]["kept"] and rows[4]["kept"]
    assert rows[2]["component_id"] == 1 and not rows[2]["kept"]
    assert rows[6]["component_id"] == rows[9]["component_id"] == 5
    assert rows[7]["n_shingles"] == 1
    lone = near_dedup.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).where("doc_id is null").collect()
    assert len(lone) == 1 and lone[0]["component_id"] is None and lone[0]["kept"]
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_dedup_chains_and_large_groups(spark):
    """Copies with one changed word each, and a chain whose ends are far apart."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 160)]
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.integers(0, 160)] = f"c{i}"
        rows.append((i, " ".join(own)))
    chain = [f"v{x}" for x in range(200)]
    for i in range(12):
        chain[i * 16] = f"n{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(f"r{x}" for x in rng.integers(0, 900, 60))) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_near_dedup_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([tuple(r) for r in docs])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_minhash_near_dedup(spark, sf).collect()}
    assert got == want


def family(n, size, changes, rng, name):
    """Copies of one text with changes of their own words, some at places that several copies change; the text itself is left out."""
    base = [f"{name}{x}" for x in range(size)]
    rows = []
    for i in range(n):
        own = list(base)
        for place in rng.choice(size, rng.integers(*changes), replace=False):
            own[place] = f"{name}c{i}x{place}" if rng.random() < 0.5 else f"{name}same{place}"
        rows.append(" ".join(own))
    return rows


def test_near_dedup_families_without_a_common_head(spark):
    rng = np.random.default_rng(11)
    texts = family(90, 150, (0, 6), rng, "a") + family(90, 150, (3, 7), rng, "b") + family(40, 300, (8, 14), rng, "c")
    near = [f"a{x}" if x % 40 else f"d{x}" for x in range(150)]
    texts += [" ".join([*near[:i], f"q{i}", *near[i + 1 :]]) for i in range(0, 150, 5)]
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), m=14, k=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def test_close_pairs_lose_no_link(spark):
    """The filter on differences, alone, against all pairs of sets."""
    rng = np.random.default_rng(3)
    head = rng.choice(1_000_000, 120, replace=False)
    sets = {1: set(head.tolist())}
    for i in range(2, 120):
        own = set(rng.choice(head, rng.integers(80, 120), replace=False).tolist()) if i % 3 else set(sets[int(rng.integers(1, i))])
        own |= {int(2_000_000 + (i * 100 + x if rng.random() < 0.6 else x)) for x in range(rng.integers(0, 25))}
        sets[i] = own
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    part = {i: 1 if linked(sets[1], s) else i for i, s in sets.items()}
    table = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "node long, shingles binary")
    pairs = spark.createDataFrame([(1, i, part[i]) for i in sets if i > 1], "head long, node long, part long")
    got = {(r["head"], r["node"]) for r in near_dedup.close_pairs(near_dedup.differences(pairs, table)).collect()}
    want = {(i, j) for i in sets for j in sets if 1 < i < j and part[i] != part[j] and linked(sets[i], sets[j])}
    every = {(i, j) for i in sets for j in sets if 1 < i < j and part[i] != part[j]}
    assert want and want <= got and len(got) < len(every) / 2


def test_near_dedup_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (0, "m n")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, node int, key int, head int, part int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 1, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
