"""Whole runs, reports, perturbed and ablated scores, prompts and models."""

import csv
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexaudit.operators import audit, models, prompts, resolve
from lexaudit.operators.extraction import RULES
from lexaudit.plans import run as runs
from lexaudit.sources import readers

FILLER = "palavra " * 320
RECORDS = [
    (1, 101, "STJ", "acordao", "Vistos, relatados e discutidos estes autos de Recurso Especial nº 1.234.567 de São Paulo."),
    (2, 102, "STJ", "acordao", f"Vistos. {FILLER} segue o precedente do REsp 1.234.567 citado."),
    (3, 103, "STF", "acordao", "Habeas Corpus nº 701.112, relatados estes autos."),
    (4, 104, "STF", "acordao", "Agravo 555.111 e Recurso 666.222. Primeiro texto."),
    (5, 105, "STF", "acordao", "Outro texto longo de abertura Agravo 555.111 fim."),
    (6, 106, "STJ", "sumula", "SÚMULA n. 83 do tribunal"),
    (7, 107, "STJ", "dispositivo", "Art. 312. a prisão preventiva poderá ser decretada"),
    *((20 + i, 200 + i, "STJ", "acordao", f"Processo 88.999 do grupo {i}.") for i in range(10)),
    *((40 + i, 300 + i, "STJ", "acordao", f"{FILLER} cita o Mandado de Segurança 44.333 e {i}") for i in range(2)),
]
LEAD = "Trata-se de recurso em que a parte sustenta o que segue, na forma "
CITES = {
    "a": ["do REsp 1.234.567/SP", "do HC 701.112/PR", "da Súmula 83 do STJ", "da Súmula 99 do STJ", "do art. 312 do CPP"],
    "b": ["do Agravo 555.111", "do RE 88.999", "do HC 44.333", "da Rcl 987.001", "do acórdão do TST de 2017, Rel. Min. Anita Prado"],
    "c": [],
}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    os.mkdir(folder / "txt")
    for name, cites in CITES.items():
        (folder / "txt" / f"{name}.txt").write_text("PETIÇÃO\nAutos: RE 1.000.000\n" + "".join(f"{LEAD}{c}; e nada mais se diz aqui.\n" for c in cites) + "Sem mais a acrescentar, a parte espera o deferimento de todos os pedidos.", encoding="utf-8")
    con = sqlite3.connect(folder / "r.db")
    con.execute("CREATE TABLE documentos (id INTEGER, tribunal TEXT, natureza TEXT, texto TEXT)")
    con.executemany("INSERT INTO documentos (rowid, id, tribunal, natureza, texto) VALUES (?, ?, ?, ?, ?)", RECORDS)
    con.commit()
    con.close()
    registry = readers.registry_from_sqlite(spark, str(folder / "r.db"), str(folder / "registry"), block=4)
    summary = runs.run(spark, str(folder / "txt"), registry, str(folder / "out"))
    return folder, registry, summary


WANT = {
    "a": [("real", 101, "cabecalho"), ("real", 103, "registro_unico"), ("real", 106, "normativo"), ("inventada", None, "normativo"), ("real", 107, "normativo")],
    "b": [("real", 104, "desempate"), ("incompleta", None, "ambiguo"), ("inventada", None, "so_mencionado"), ("inventada", None, "sem_candidato"), ("incompleta", None, "sem_identificador")],
}


def test_one_run_writes_contract_and_submission(spark, world):
    folder, registry, summary = world
    assert registry.count() == len(RECORDS)
    rows = spark.read.parquet(f"{folder}/out/resolved").orderBy("doc_id", "idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["class"], r["record_id"], r["path"]))
    assert got == WANT
    assert summary == {"n_documents": 3, "n_citations": 10, "n_chosen": 1, "model": "absent"}
    for name, cites in CITES.items():
        made = json.loads((folder / "out" / "json" / f"{name}.json").read_text(encoding="utf-8"))
        assert made["documento_id"] == name and len(made["citacoes"]) == len(cites)
        text = (folder / "txt" / f"{name}.txt").read_text(encoding="utf-8")
        assert all(text[c["inicio"] : c["fim"]] == c["trecho"] and c["trecho"] in cite for c, cite in zip(made["citacoes"], cites, strict=True))
    part, = [x for x in os.listdir(folder / "out" / "submission") if x.endswith(".csv")]
    with open(folder / "out" / "submission" / part, encoding="utf-8", newline="") as file:
        cells = {r["documento_id"]: r["citacoes"] for r in csv.DictReader(file)}
    assert cells["c"] == "-" and cells["b"].count("|") == 4 and cells["a"].split("|")[0].endswith("real,101,1.0000")


@pytest.fixture(scope="module")
def scored(spark, world):
    folder, registry, _ = world
    predicted = spark.read.parquet(f"{folder}/out/resolved")
    docs = readers.documents(spark, f"{folder}/txt")
    gold = predicted.withColumn("wrong", (F.col("doc_id") == "a") & (F.col("idx") == 1)).select(
        "doc_id", F.col("idx").alias("line"), "start", "end", F.when(F.col("wrong"), F.lit("inventada")).otherwise(F.col("class")).alias("class"), F.when(~F.col("wrong"), F.col("record_id")).alias("record_id"), F.when(F.col("doc_id") == "a", F.lit(1)).otherwise(F.lit(2)).alias("level")
    )
    extra = spark.createDataFrame([("c", 0, 0, 4, "real", 1, 2)], gold.schema)
    return docs, predicted, gold.unionByName(extra), runs.base(registry, f"{folder}/base")


def test_report(spark, world, scored, tmp_path):
    docs, predicted, gold, _ = scored
    found = runs.write_report(runs.report(predicted, gold, "r1"), f"{tmp_path}/report.json")
    assert found == json.loads((tmp_path / "report.json").read_text(encoding="utf-8"))
    assert found["extraction"] == {"n_gold": 11, "n_missed": 1, "missed": ["c:0"]} and found["revision"] == "r1" and found["prompt"] == prompts.current("choice").label
    assert found["paths"]["normativo"] == {"n_right": 3, "n": 3} and found["paths"]["registro_unico"] == {"n_right": 0, "n": 1}
    assert found["levels"]["1"]["fabricated_as_real"] == 1 and found["levels"]["2"]["f1_by_class"]["incompleta"] == 1.0
    assert found["score"] == pytest.approx((found["levels"]["1"]["score"] + found["levels"]["2"]["score"]) / 2)


def test_scores_of_perturbed_texts_and_without_rules(spark, scored):
    docs, predicted, gold, on = scored
    plain = {r["level"]: r["score"] for r in runs.scored(predicted, gold).collect()}
    assert {(r["perturbation"], r["level"]): r["score"] for r in runs.perturbed_scores(docs, gold, on, ["other_ordinal"]).collect()} == {("other_ordinal", k): v for k, v in plain.items()}
    drops = {r["rule"]: r for r in runs.ablated_scores({"a": (docs, gold, on), "b": (docs.where("doc_id <> 'b'"), gold.where("doc_id <> 'b'"), on)}, frozenset({"numbered"})).collect()}
    assert drops["numbered"]["drop_a"] > 0.1 and drops["numbered"]["drop_b"] > 0.1 and set(drops) == {"numbered"}


def test_revisions_and_their_questions(spark, scored):
    docs, predicted, gold, on = scored
    now, before = (lambda d: runs.predict(d, on)), (lambda d: runs.predict(d, on, RULES - {"summary"}))
    assert [r["doc_id"] for r in runs.compared(docs, before, now).collect()] == ["a"]
    asked = runs.questions(docs, on)
    assert [(r["doc_id"], r["idx"], r["total"]) for r in asked.collect()] == [("b", 0, 2)] and "1. Agravo 555.111 e Recurso 666.222." in asked.first()["question"]
    old = runs.questions(docs, on, prompt=prompts.version("choice", "1"))
    assert audit.changed_prompts(asked, asked).count() == 0 and audit.changed_prompts(asked, old).count() == 1


def test_a_model_is_loaded_once_and_asked_in_batches(spark, scored, tmp_path):
    docs, _, _, on = scored
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}", "x").close()

        def answer(system, questions):
            assert len(questions) <= 2 and "Reply with one number" in system
            return ["Opção 2" for _ in questions]

        return answer

    chooser = models.Loaded("test", load, batch=2)
    got = runs.predict(docs, on, chooser=chooser).where("path = 'desempate'").collect()
    assert [(r["doc_id"], r["record_id"]) for r in got] == [("b", 105)]
    assert len(os.listdir(folder)) == 1
    direct = models.Loaded("direct", lambda: models.first_option, 2)
    assert direct("", []) == [] and "direct" not in models._loaded
    assert direct("", ["x"] * 5) == ["1"] * 5
    with pytest.raises(ValueError):
        models.Loaded("short", lambda: lambda s, q: [], 2)("", ["x"])


def test_gold_ids_are_exact(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\ufeffdocumento_id,citacao_id,inicio,fim,classificacao,id_canonico,nivel\nd,1,0,5,real,9007199254740993,1\nd,2,6,9,real,12.0,1\nd,3,10,12,inventada,,2\n", encoding="utf-8")
    assert [r["record_id"] for r in readers.gold(spark, f"{tmp_path}/g.csv").orderBy("citation_id").collect()] == [9007199254740993, 12, None]


def test_prompts_are_kept_by_version():
    assert prompts.current("choice") is prompts.CHOICE[-1] and prompts.version("choice", "1").label == "choice@1"
    assert len({p.version for p in prompts.CHOICE}) == len(prompts.CHOICE)


def test_tokens_without_marks(spark):
    from lexaudit.operators.textindex import tokens

    texts = ["e\u0301cole École ÉCOLE", "Tiếng Việt", "ação ac\u0327a\u0303o", "ß ñ ø"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["w"] for r in frame.orderBy("i").select(tokens(F.col("t")).alias("w")).collect()] == [["ecole"] * 3, ["tieng", "viet"], ["acao"] * 2, ["ß", "n", "ø"]]


def test_identifiers_of_long_and_dotted_blocks(spark):
    from lexaudit.functions.identifiers import identifiers

    frame = spark.createDataFrame([("RE 5" + "." * 30 + "l2",), ("RE l23.45O/SP",)], "t string")
    got = [r["x"] for r in frame.select(identifiers(F.col("t")).alias("x")).collect()]
    assert got == [["5" + "." * 30 + "12"], ["123.450"]]
