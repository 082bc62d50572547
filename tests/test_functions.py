import pytest
from pyspark.sql import functions as F

from lexaudit.functions import perturb
from lexaudit.functions.family import family, files, kind
from lexaudit.functions.identifiers import group_thousands, identifiers
from lexaudit.functions.text import collapse, is_prose, preamble_end
from lexaudit.operators import normindex, resolve, spans, textindex


def one(spark, value, function, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("snippet", "ids"),
    [
        ("HC 701.112/PR", ["701.112"]),
        ("REsp 2.0l5.330/AM", ["2.015.330"]),
        ("RMS nº l20.774/MT", ["120.774"]),
        ("Rcl 31 204/SE", ["31.204"]),
        ("REsp 1234567", ["1.234.567"]),
        ("REsp 170076O/SP", ["1.700.760"]),
        ("processo 06003164920206160182", ["0600316-49.2020.6.16.0182"]),
        ("processo 0600316-49.2020.\n6.16.0182", ["0600316-49.2020.6.16.0182"]),
        ("acórdão do TRF5 de 2016", []),
        ("TRT 15, RR 1000", ["1.000"]),
        ("Petição 45.556/2023", ["45.556"]),
        ("Rcl 2020", ["2.020"]),
        ("julgado de 2019", []),
        ("Tema 5", []),
        ("21737l8 - SP", ["2.173.718"]),
        ("33.-\n474", ["33.-474"]),
        ("", []),
    ],
)
def test_identifiers(spark, snippet, ids):
    assert one(spark, snippet, identifiers) == ids


def test_identifiers_of_null(spark):
    assert one(spark, None, identifiers) is None
    assert [one(spark, x, group_thousands) for x in ("1", "123", "1234", "1234567")] == ["1", "123", "1.234", "1.234.567"]


def test_collapse_knows_every_blank(spark):
    text = " a\u001cb\u001f c\u0085\n\td​e "
    assert one(spark, text, collapse) == " ".join(text.split())


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("RHC 1.222", "habeas"),
        ("AgInt no AREsp 5", "especial"),
        ("REspe 7", "eleitoral"),
        ("AI-RR-5", "revista"),
        ("Recurso de Revista", "revista"),
        ("XPTO 5", None),
        ("agravo de instrumento", "revista"),
        ("Mandado de Segurança (MS 5)", "mandado"),
    ],
)
def test_family(spark, text, name):
    assert one(spark, text, family) == name


def test_filing_formula_reaches_240_characters(spark):
    text = "Vistos, relatados e discutidos" + " x" * 90 + " 1.234"
    assert one(spark, text, lambda c: files(c, F.lit(len(text) - 5)))
    far = "Vistos, relatados e discutidos" + " x" * 200 + " 1.234"
    assert not one(spark, far, lambda c: files(c, F.lit(len(far) - 5)))
    assert [one(spark, x, kind) for x in ("art. 5º", " Artigo 9", "REsp 5", "arte 5")] == ["lei", "lei", "jurisprudencia", "jurisprudencia"]


def test_preamble(spark):
    prose = "Trata-se de recurso em que a parte sustenta que a decisão deve ser reformada pelo tribunal."
    head = "EXCELENTÍSSIMO SENHOR\nAutos: 1.234\nApelante: Fulano de Tal, brasileiro, casado, residente nesta cidade e comarca\n"
    assert one(spark, head + prose, preamble_end) == len(head)
    assert one(spark, "curta\ncurta", preamble_end) == 0
    assert one(spark, "linha\n" * 500, preamble_end) == 2000
    assert one(spark, "", preamble_end) == 0
    assert one(spark, prose, is_prose) and not one(spark, prose.upper(), is_prose) and not one(spark, prose[:59], is_prose)


def test_native_spans_count_code_points(spark):
    text = "\U0001f600 12 é 345 \u0001 6"
    got = [(r["start"], r["end"], r["snippet"]) for r in one(spark, text, lambda c: spans.find_spans(c, "[0-9]+"))]
    assert got == [(2, 4, "12"), (7, 10, "345"), (13, 14, "6")]
    assert one(spark, "none", lambda c: spans.find_spans(c, "[0-9]+")) == [] == one(spark, None, lambda c: spans.find_spans(c, "[0-9]+"))


def test_span_deduplication(spark):
    rows = [(0, 10), (2, 9), (8, 20), (9, 20), (30, 40), (33, 45)]
    df = spark.createDataFrame([([(a, b, "") for a, b in rows],)], f"x {spans.SPAN}")
    assert [(r["start"], r["end"]) for r in spans.deduplicate(df, "x").first()["x"]] == [(0, 10), (8, 20), (30, 40), (33, 45)]


def test_overlapping_pairs_across_cells(spark):
    a = spark.createDataFrame([(1, 0, 1000), (1, 300, 310)], "doc_id int, start int, end int")
    b = spark.createDataFrame([(1, 305, 320), (1, 900, 2000), (2, 0, 10)], "doc_id int, start int, end int")
    got = sorted((r["a_start"], r["b_start"]) for r in spans.overlapping_pairs(a, b).collect())
    assert got == [(0, 305), (0, 900), (300, 305)]


def test_tokens_fold_case_and_marks(spark):
    assert one(spark, "O Nº 1.234-É Ação, ção_x́", textindex.tokens)[:6] == ["o", "nº", "1", "234", "e", "acao"]


def test_first_occurrence(spark):
    df = spark.createDataFrame([("é 1 234\n.567 e 1.234.567", "1.234.567"), ("nada", "1.234"), ("x12345", "234")], "t string, i string")
    got = [r["o"] and (r["o"]["position"], r["o"]["start"], r["o"]["end"]) for r in df.select(textindex.first_occurrence(F.col("t"), F.col("i")).alias("o")).collect()]
    assert got == [(3, 2, 12), None, (3, 2, 5)]


def test_answers(spark):
    cases = [("Opção 3", 4, 2), ("0", 3, -1), ("7", 2, 0), ("", 2, 0), ("nenhum", 2, 0), ("2.", 2, 1), ("99999999999", 5, 0)]
    df = spark.createDataFrame(cases, "a string, n int, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", resolve.answer_index(F.col("a"), F.col("n")).alias("got")).collect())
    texts = spark.createDataFrame([(["  um\n dois", "tres" * 100],)], "x array<string>")
    assert texts.select(resolve.options(F.col("x")).alias("y")).first()["y"] == "1. um dois\n2. " + "tres" * 50


def test_windows(spark):
    words = [f"w{i}" for i in range(60)]
    assert one(spark, " ".join(words), normindex.windows) == [" ".join(words[i : i + 8]) for i in range(0, 48, 8)]
    assert one(spark, "a b", normindex.windows) == ["a b"]
    assert len(one(spark, " ".join(words[:24]), normindex.windows)) == 2


def test_literal_starts(spark):
    df = spark.createDataFrame([("a.b a.b axb", "a.b"), ("none", "zz")], "t string, p string")
    assert [r["s"] for r in df.select(normindex.literal_starts(F.col("t"), F.col("p")).alias("s")).collect()] == [[0, 4], []]


def test_perturbations_keep_length_and_repeat(spark):
    text = "REsp 1.234.567/SP nº 5 - fim " * 200
    for name, change in perturb.PERTURBATIONS.items():
        got = one(spark, text, lambda c, change=change: change(F.lit(7), c))
        assert len(got) == len(text) and (got == text) == (name == "original")
        assert got == one(spark, text, lambda c, change=change: change(F.lit(7), c))
