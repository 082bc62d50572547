import json
import sqlite3

import pytest

from lexaudit.operators import normindex, resolve, textindex
from lexaudit.sources import contract, readers

CITATION = "doc_id int, idx int, snippet string, family string, normative boolean, norm_id long, n_identifiers int, ambiguous boolean"
HIT = "doc_id int, idx int, record_id long, position int, family string, files boolean, text string"


def decide(spark, hits, family=None, normative=False, norm_id=None, n=1, ambiguous=False, chooser=None):
    citations = spark.createDataFrame([(1, 0, "REsp 5", family, normative, norm_id, n, ambiguous)], CITATION)
    rows = spark.createDataFrame([(1, 0, *h, f"texto {h[0]}") for h in hits], HIT)
    r = resolve.resolve_hits(citations, rows, chooser).first()
    return r["class"], r["record_id"], r["path"], r["confidence"]


@pytest.mark.parametrize(
    ("hits", "given", "want"),
    [
        ([], {"normative": True, "norm_id": 9}, ("real", 9, "normativo", 1.0)),
        ([], {"normative": True}, ("inventada", None, "normativo", 1.0)),
        ([], {"n": 0}, ("incompleta", None, "sem_identificador", 1.0)),
        ([(7, 5000, "especial", False), (7, 10, "habeas", False)], {}, ("real", 7, "registro_unico", 1.0)),
        ([], {"ambiguous": True}, ("incompleta", None, "ambiguo", None)),
        ([], {}, ("inventada", None, "sem_candidato", 1.0)),
        ([(7, 50, "x", False), (8, 9000, "x", False)], {}, ("real", 7, "cabecalho", 1.0)),
        ([(9, 30, "x", False), (8, 31, "x", False)], {}, ("real", 8, "registro_unico", 1.0)),
        ([(9, 30, "x", False), (8, 300, "x", True)], {}, ("real", 8, "especie", None)),
        ([(9, 30, "x", False), (8, 300, "x", False)], {}, ("real", 9, "desempate", None)),
        ([(9, 3000, "x", False), (8, 2500, "x", False)], {}, ("real", 8, "especie_ilegivel", None)),
        ([(9, 3000, "x", False), (8, 2500, "x", False)], {"family": "y"}, ("inventada", None, "so_mencionado", None)),
        ([(9, 3000, "y", False), (8, 2500, "x", True)], {"family": "y"}, ("real", 9, "especie", None)),
        ([(9, 3000, "y", True), (8, 2500, "y", False)], {"family": "y"}, ("real", 9, "especie", None)),
        ([(9, 3000, "y", True), (8, 2500, "y", True)], {"family": "y"}, ("real", 8, "especie", None)),
        ([(9, 2000, "y", True), (8, 1999, "z", True)], {"family": "y"}, ("real", 8, "cabecalho", 1.0)),
    ],
)
def test_rules(spark, hits, given, want):
    assert decide(spark, hits, **given) == want


def test_chooser_gets_disputes_alone(spark):
    both = [(9, 30, "x", False), (8, 300, "x", False)]
    assert decide(spark, both, chooser=lambda system, asked: ["2"] * len(asked)) == ("real", 8, "desempate", None)
    assert decide(spark, both, chooser=lambda system, asked: ["0"] * len(asked)) == ("inventada", None, "so_mencionado", None)

    def never(prompts):
        raise AssertionError("no dispute, no call")

    assert decide(spark, both[:1], chooser=never)[2] == "registro_unico"


REGISTRY = [
    (1, 11, "STJ", "acordao", "Vistos, relatados e discutidos estes autos de Recurso Especial nº 1.234.567, de São Paulo."),
    (2, 12, "STJ", "acordao", "palavra " * 400 + "como se decidiu no HC 55.120 e no REsp 77 88."),
    (3, 13, None, "sumula", "SÚMULA n. 83 - Não se conhece."),
    (4, 14, None, "sumula", "A mera falta de prova do dano moral alegado não afasta o dever de indenizar."),
    (5, 15, None, "dispositivo", "Art. 5. Todos são iguais perante a lei, sem distinção."),
    (6, 16, None, "dispositivo", "Art. 5. Todos são iguais perante a lei (cópia)."),
    (7, 17, "STF", "acordao", "Diz a Súmula 200 e a Súmula 201 que: A mera falta de prova do dano moral alegado não afasta o dever de indenizar."),
    (8, 18, "STF", "acordao", "Segundo a Súmula 201, A mera falta de prova do dano moral alegado não afasta."),
    *[(100 + i, 100 + i, "STF", "acordao" if i else "sumula", f"processo 4.321 número {i}") for i in range(9)],
]
CITES = [
    (1, 0, "REsp 1.234.567/SP", ("real", 11, "registro_unico")),
    (1, 1, "RE 1.234.568", ("inventada", None, "sem_candidato")),
    (1, 2, "Rcl 4.321", ("incompleta", None, "ambiguo")),
    (1, 3, "Súmula 83 do STJ", ("real", 13, "normativo")),
    (1, 4, "Súmula 201 do STF", ("real", 14, "normativo")),
    (1, 5, "Súmula 202 do STF", ("inventada", None, "normativo")),
    (1, 6, "art. 5º da Constituição Federal", ("real", 16, "normativo")),
    (1, 7, "art. 5º do CPC", ("inventada", None, "normativo")),
    (1, 8, "acórdão do TST de 2017", ("incompleta", None, "sem_identificador")),
    (2, 0, "REsp l.234.567", ("real", 11, "registro_unico")),
    (2, 1, "RE 9.999.999 (4.321)", ("inventada", None, "sem_candidato")),
]


def registry_frame(spark):
    return spark.createDataFrame(REGISTRY, "row_id long, record_id long, court string, nature string, text string")


def test_verification_end_to_end(spark):
    registry = registry_frame(spark)
    postings = textindex.index(registry)
    norms = normindex.build(registry, postings)
    assert {(r["kind"], r["number"], r["code"]): r["record_id"] for r in norms.collect() if r["number"] != ""} == {("sumula", "83", ""): 13, ("sumula", "201", ""): 14, ("artigo", "5", "constituicao"): 16}
    cites = spark.createDataFrame([c[:3] for c in CITES], "doc_id int, idx int, snippet string")
    got = {(r["doc_id"], r["idx"]): (r["class"], r["record_id"], r["path"]) for r in resolve.verify(cites, registry, postings, norms).collect()}
    assert got == {(d, i): want for d, i, _, want in CITES}


def test_contract_outputs(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    rows = spark.createDataFrame([("a", 1, 5, 9, 'x "q"', "inventada", None, None, "ambiguo"), ("a", 0, 1, 4, "art. 5", "real", 7, 1.0, "normativo")], "doc_id string, idx int, start int, end int, snippet string, class string, record_id long, confidence double, path string")
    assert {r["documento_id"]: r["citacoes"] for r in contract.cells(docs, rows).collect()} == {"a": "1,4,real,7,1.0000|5,9,inventada,-,-", "b": "-"}
    made = contract.contract(docs, rows)
    got = {r["documento_id"]: json.loads(r["json"]) for r in made.collect()}
    assert got["b"] == {"documento_id": "b", "citacoes": []}
    assert got["a"]["citacoes"] == [
        {"inicio": 1, "fim": 4, "trecho": "art. 5", "tipo": "lei", "classificacao": "real", "confianca": 1.0, "resolucao": {"id_canonico": "7"}},
        {"inicio": 5, "fim": 9, "trecho": 'x "q"', "tipo": "jurisprudencia", "classificacao": "inventada"},
    ]
    contract.write_pretty(made, f"{tmp_path}/json")
    text = (tmp_path / "json" / "a.json").read_text()
    assert text.endswith("}\n") and json.loads(text) == got["a"] and '\n  "citacoes"' in text
    contract.write_csv(contract.cells(docs, rows), f"{tmp_path}/csv")
    contract.write_json(made, f"{tmp_path}/lines")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2 == spark.read.json(f"{tmp_path}/lines").count()


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "um.txt").write_bytes("é\r\nx\r".encode())
    (tmp_path / "docs" / "skip.md").write_text("no")
    assert [tuple(r) for r in readers.documents(spark, f"{tmp_path}/docs").collect()] == [("um", "é\nx\n")]
    (tmp_path / "gold.csv").write_text("﻿documento_id,citacao_id,inicio,fim,classificacao,id_canonico,nivel\num,c1,0,5,real,12.0,1\num,c2,9,12,inventada,,2\n", encoding="utf-8")
    assert [(r["doc_id"], r["start"], r["record_id"], r["level"]) for r in readers.gold(spark, f"{tmp_path}/gold.csv").collect()] == [("um", 0, 12, 1), ("um", 9, None, 2)]
    con = sqlite3.connect(tmp_path / "r.db")
    con.execute("CREATE TABLE documentos (documento_id TEXT, id INTEGER, tribunal TEXT, natureza TEXT, texto TEXT)")
    con.execute("INSERT INTO documentos VALUES ('d', 5, NULL, 'acordao', 'texto')")
    con.commit()
    con.close()
    found = readers.registry_from_sqlite(spark, f"{tmp_path}/r.db", f"{tmp_path}/exported", block=2)
    assert [tuple(r) for r in found.collect()] == [(1, 5, None, "acordao", "texto")]
    found.write.parquet(f"{tmp_path}/r")
    assert readers.registry(spark, f"{tmp_path}/r").count() == 1
