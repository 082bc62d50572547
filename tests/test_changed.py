"""Revisions are compared by the whole list of each document's predictions."""

import duckdb

from lexaudit.operators import audit
from lexaudit.plans import adapters, registry

SF = "/root/testdata/sf0.001"


def test_any_prediction_of_a_document_counts(spark):
    shape = "doc_id long, idx int, class string, record_id long"
    a = spark.createDataFrame([(1, 2, "real", 5), (1, 1, "real", 4), (2, 1, "real", 4), (2, 2, "real", 5), (3, 2, "real", None), (4, 1, "real", 1), (4, 2, "real", 2)], shape)
    b = spark.createDataFrame([(1, 1, "real", 4), (1, 2, "real", 5), (2, 1, "real", 4), (2, 2, "real", 6), (3, 2, "real", 7), (4, 1, "real", 1), (5, 3, "real", 1)], shape)
    docs = spark.createDataFrame([(d,) for d in range(1, 7)], "doc_id long")
    both = [audit.listed(x, docs, ["class", "record_id"]) for x in (a, b)]
    assert {r["doc_id"] for r in audit.changed(*both, ["predictions"]).collect()} == {2, 3, 4, 5}


def test_query_looks_at_every_line(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    lists = [{}, {}]
    for side, sql in zip(lists, (adapters.PREDICTED, adapters.REVISED), strict=True):
        for r in sorted(db.sql(f'SELECT doc_id, idx, start, "end", class, record_id, confidence FROM ({sql})').fetchall(), key=lambda r: r[:2]):
            side.setdefault(r[0], []).append(r[2:])
    docs = lists[0].keys() | lists[1].keys()
    want = {d: (len(lists[0].get(d, [])), len(lists[1].get(d, []))) for d in docs if lists[0].get(d, []) != lists[1].get(d, [])}
    got = {r["doc_id"]: (r["n_was"], r["n_became"]) for r in registry.queries()["q_changed"](spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)
