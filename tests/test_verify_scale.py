"""Verification makes a registry's texts in many tasks, and posts what identifiers may have alone."""

import re

from lexaudit.functions.identifiers import TOKEN_LETTERS
from lexaudit.operators import textindex
from lexaudit.operators.citations import FORMS, forward
from lexaudit.plans.adapters import REGISTRY, derived

SF = "/root/testdata/sf0.001"
TEXTS = [
    "REsp 1.234.567/SP e HC 55 120", "12abc 34", "abc12 34", "12–34", "12́ 34", "12.́́34", "ab ́12 34", "́12abc 34", "1 Ó 2", "Ó12 é 34", "1-S-2.3 x 2", "ſ12 34 İ5",
    "12 palavra 34", "", None, "  12\n34 ", "l2 O3", "12 ², 34", "x 12", "𝟙2 34", "a12.34b 12.34", "34",
]
PHRASES = ["1.234.567", "55 120", "12 34", "34", "1 o 2", "o12", "1-S-2.3", "l2 o3", "i5", "12", "2", "3 x", "s"]


def test_number_index_finds_what_the_whole_index_finds(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    phrases = spark.createDataFrame([(p,) for p in PHRASES if p != "3 x"], "phrase string")
    pairs = lambda made: sorted(map(tuple, textindex.phrase_hits(made, phrases).select("phrase", "row_id").distinct().collect()))
    found = pairs(textindex.number_index(docs, TOKEN_LETTERS))
    assert found == pairs(textindex.index(docs)) and len(found) > 20
    assert textindex.number_index(docs, TOKEN_LETTERS).where("token = 'palavra'").count() == 0


def test_registry_is_made_in_as_many_tasks_as_an_exchange_has(spark):
    made = derived(spark, SF, REGISTRY, "orders", dealt="o_orderkey")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(made.collect()) == sorted(derived(spark, SF, REGISTRY, "orders").collect())


def test_openings_begin_a_word_where_they_must():
    assert list(forward("xa a", re.compile("a"), lambda t, i: i + 1)) == [(3, 4)]
    assert list(FORMS["kind_year"]("RMS de 2019. Relator: nada. RMS de 2019, Rel. Min. Ana")) == [(28, 54)]
