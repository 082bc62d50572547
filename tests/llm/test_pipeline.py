import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_dedup import brute_components
from test_rows import brute_contamination
from tokenizers import Tokenizer

from lexaudit.llm import quality

SF = "/root/testdata/sf0.01"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= 0.3}
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] in good}
    last = {}
    for d in sorted(rows):
        last[rows[d]] = d
    rows = {d: t for d, t in rows.items() if last[t] == d}
    parts = brute_components(list(rows.items()))
    rows = {d: t for d, t in rows.items() if parts[d][1] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_contamination(list(rows.items()), items)
    rows = {d: t for d, t in rows.items() if found[d][1] == 0}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 1000


def test_stages_keep_the_columns_and_take_edge_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (5, "x " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert out.count() <= len(rows)
    ids = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()}
    assert ids == {None, 3, 4, 5}
