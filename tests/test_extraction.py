import pytest

from lexaudit.operators.citations import spans
from lexaudit.operators.extraction import RULES, extract


def found(text, rules=RULES):
    return [text[a:b] for a, b in spans(text, rules, "quantity" in rules, "label" in rules)]


@pytest.mark.parametrize(
    ("text", "snippet"),
    [
        ("Vide o HC 701.112/PR.", "HC 701.112/PR"),
        ("Ademais a Reclamação nº 40.118/GO", "Reclamação nº 40.118/GO"),
        ("Confira-se o Agravo em Recurso Especial 55.120 - MG", "Agravo em Recurso Especial 55.120 - MG"),
        ("no RMS nº l20.774/MT, que", "RMS nº l20.774/MT"),
        ("RHC 90.321/SC, DJe de 2/2/2022", "RHC 90.321/SC"),
        ("nos termos do art. 44, II, do CPP", "art. 44, II, do CPP"),
        ("artigo 7º, XXIX, da Constituição Federal", "artigo 7º, XXIX, da Constituição Federal"),
        ("art. 14 do Decreto-Lei nº 27.427/00.", "art. 14 do Decreto-Lei nº 27.427/00"),
        ("Súmula 512 do STF", "Súmula 512 do STF"),
        ("5úm. 83 do STJ", "5úm. 83 do STJ"),
        ("o Tema 1.046 da repercussão geral", "Tema 1.046 da repercussão geral"),
        ("acórdão do TST de 2017, Rel. Min. Ana Prado.", "acórdão do TST de 2017, Rel. Min. Ana Prado"),
        ("entendimento firmado pela Segunda Turma do STF em 2021", "entendimento firmado pela Segunda Turma do STF em 2021"),
        ("na Rcl de 2021, Rel. Min. Rosa Maria", "Rcl de 2021, Rel. Min. Rosa Maria"),
        ("Apelação do TJSP, de 2015, sob relatoria do Des. José Souza", "Apelação do TJSP, de 2015, sob relatoria do Des. José Souza"),
    ],
)
def test_spans(text, snippet):
    assert snippet in found(text)


@pytest.mark.parametrize(
    "text",
    ["Matrícula 55.120", "fls. 310", "prazo de 30 dias", "Protocolo nº 2023.1475691", "Multa de 20", "DJe de 2/2/2022", "ID 61582938", "a jurisprudência deste Tribunal", "reiterados precedentes do STJ", "Portaria 123", "O Evento 17"],
)
def test_numbers_that_are_no_citations(text):
    assert found(text) == []


def test_rules_can_be_switched_off():
    assert found("Matrícula 55.120", RULES - {"label"}) == ["Matrícula 55.120"]
    assert found("Prazo de 30", RULES - {"quantity", "label"}) == ["Prazo de 30"]
    assert found("acórdão do TST de 2017", RULES - {"ruling"}) == []
    assert found("HC 701.112/PR e Súmula 512 do STF", RULES - {"numbered"}) == ["Súmula 512 do STF"]


def test_long_runs_do_not_hang():
    text = "Recurso " * 3000 + "1.2" * 5000 + " " + "A " * 3000
    assert isinstance(found(text), list)


def test_extract_drops_the_preamble_and_orders_by_place(spark):
    body = "Trata-se de recurso em que a parte sustenta que a decisão deve ser reformada, na forma do REsp 1.234.567/SP e da Súmula 83 do STJ."
    docs = spark.createDataFrame([(1, "Autos: RE 999.888\n" + body, "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, start string")
    rows = extract(docs).collect()
    assert [(r["doc_id"], r["idx"], r["snippet"]) for r in rows] == [(1, 0, "REsp 1.234.567/SP"), (1, 1, "Súmula 83 do STJ")]
    assert all(("Autos: RE 999.888\n" + body)[r["start"] : r["end"]] == r["snippet"] for r in rows)
    assert extract(docs, RULES - {"preamble"}).count() == 3


def test_streamed_extraction_is_the_batch(spark, tmp_path):
    from lexaudit.streaming.extract import stream_citations, stream_documents

    docs = spark.createDataFrame([("a", "na forma do REsp 1.234.567/SP"), ("b", "sem nada")], "doc_id string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream_citations(stream_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert [r["snippet"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [r["snippet"] for r in extract(docs).collect()] == ["REsp 1.234.567/SP"]
