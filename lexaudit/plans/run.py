"""Whole runs: from texts and a registry to the contract and the submission, their scores, and runs compared."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.perturb import PERTURBATIONS
from ..operators import audit, evaluate, normindex, prompts, resolve, textindex
from ..operators.extraction import RULES, extract
from ..operators.models import Answerer
from ..sources import contract, readers

KEY = resolve.KEY


@dataclass(frozen=True)
class Base:
    """What citations are looked up in: a registry, its stored index and its normative index."""

    registry: DataFrame
    postings: DataFrame
    norms: DataFrame


def base(registry: DataFrame, folder: str) -> Base:
    """The base of a registry (row_id, record_id, court, nature, text); both indexes are written to folder once."""
    postings = textindex.stored(textindex.index(registry), f"{folder}/index")
    normindex.build(registry, postings).write.parquet(f"{folder}/norms")
    return Base(registry, postings, registry.sparkSession.read.parquet(f"{folder}/norms"))


def predict(docs: DataFrame, on: Base, rules: frozenset[str] = RULES, chooser: Answerer | None = None, prompt: prompts.Prompt | None = None, cited: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, start, end, snippet, class, record_id, confidence, path) of every citation of docs; cited: their citations, if they are known."""
    cites = extract(docs, rules) if cited is None else cited
    return cites.join(resolve.verify(cites, on.registry, on.postings, on.norms, chooser, prompt), KEY)


def questions(docs: DataFrame, on: Base, rules: frozenset[str] = RULES, prompt: prompts.Prompt | None = None) -> DataFrame:
    """(doc_id, idx, prompt, system, question, total): what a run would ask a model, without one."""
    return resolve.questions(resolve.disputes(*resolve.found_hits(extract(docs, rules), on.registry, on.postings, on.norms, True)), prompt)


def run(spark: SparkSession, texts: str, registry: DataFrame, out: str, chooser: Answerer | None = None) -> dict:
    """One run over a folder of .txt files; writes into the folder out and returns its summary.

    out/json has one contract document a text, out/contract the same as JSON
    lines, out/submission the CSV, out/citations and out/resolved the tables
    behind them, out/base both indexes.
    """
    docs = readers.documents(spark, texts)
    extract(docs).write.parquet(f"{out}/citations")
    cites = spark.read.parquet(f"{out}/citations")
    predict(docs, base(registry, f"{out}/base"), chooser=chooser, cited=cites).write.parquet(f"{out}/resolved")
    resolved = spark.read.parquet(f"{out}/resolved")
    made = contract.contract(docs, resolved)
    contract.write_json(made, f"{out}/contract")
    contract.write_pretty(made, f"{out}/json")
    contract.write_csv(contract.cells(docs, resolved), f"{out}/submission")
    return summary(docs, resolved, chooser).first().asDict()


def summary(docs: DataFrame, resolved: DataFrame, chooser: Answerer | None = None) -> DataFrame:
    """One row (n_documents, n_citations, n_chosen, model): how many disputes a chooser or the stub settled, and whether a model was needed."""
    told = resolved.agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(F.col("path") == "desempate").alias("n_chosen"))
    n = docs.agg(F.count(F.lit(1)).alias("n_documents"))
    model = F.when(F.col("n_chosen") == 0, F.lit("not needed")).otherwise(F.lit("absent" if chooser is None else "asked"))
    return n.join(told).select("n_documents", "n_citations", "n_chosen", model.alias("model"))


def report(predicted: DataFrame, gold: DataFrame, revision: str = "", chooser: Answerer | None = None, prompt: prompts.Prompt | None = None) -> DataFrame:
    """One row (json): scores by level, coverage with the citations that were missed, and right answers by path."""
    matched = evaluate.match(predicted, gold)
    by_class = evaluate.class_scores(matched, gold).where("level >= 0").groupBy("level").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "f1")))).alias("f1_by_class"))
    levels = evaluate.score(matched, gold).join(by_class, "level").select("level", F.struct("score", "macro_f1", "f1_by_class", "brier", "real_as_fabricated", "fabricated_as_real").alias("s"))
    listed = levels.agg(F.collect_list(F.struct("level", "s")).alias("l"), F.avg("s.score").alias("score"))
    lost = evaluate.missing(predicted, gold).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")))).alias("missed"))
    paths = evaluate.paths(matched).agg(F.array_sort(F.collect_list(F.struct("path", F.struct("n_right", "n").alias("p")))).alias("p"))
    n = gold.agg(F.count(F.lit(1)).alias("n_gold"))
    joined = listed.join(lost).join(paths).join(n)
    used = prompt or prompts.current("choice")
    body = F.struct(
        F.lit(revision).alias("revision"),
        F.lit(used.label).alias("prompt"),
        F.lit("absent" if chooser is None else getattr(chooser, "name", "asked")).alias("model"),
        "score",
        F.map_from_entries(F.transform("l", lambda x: F.struct(x["level"].cast("string"), x["s"]))).alias("levels"),
        F.struct("n_gold", F.size("missed").alias("n_missed"), "missed").alias("extraction"),
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["path"], x["p"]))).alias("paths"),
    )
    return joined.select(F.to_json(body).alias("json"))


def write_report(made: DataFrame, path: str) -> dict:
    """The report as one indented JSON file on the driver's machine; returns it."""
    found = json.loads(made.first()["json"])
    with open(path, "w", encoding="utf-8") as file:
        json.dump(found, file, ensure_ascii=False, indent=2)
    return found


def perturbed_scores(docs: DataFrame, gold: DataFrame, on: Base, names: list[str] | None = None) -> DataFrame:
    """(perturbation, level, score, ...): the score of each level under each perturbation of the texts."""

    def one(name: str) -> DataFrame:
        changed = docs.select("doc_id", PERTURBATIONS[name](F.col("doc_id"), F.col("text")).alias("text"))
        return scored(predict(changed, on), gold).select(F.lit(name).alias("perturbation"), "*")

    parts = [one(name) for name in names or PERTURBATIONS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scored(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores by level of predictions on any base and gold table."""
    return evaluate.score(evaluate.match(predicted, gold), gold)


def ablated_scores(bases: dict[str, tuple[DataFrame, DataFrame, Base]], rules: frozenset[str] = RULES) -> DataFrame:
    """(rule, drop_a, drop_b, asymmetry, flagged) of runs without each rule on the bases a and b, each (docs, gold, base)."""

    def runs(name: str) -> Callable[[frozenset[str]], DataFrame]:
        docs, gold, on = bases[name]
        return lambda kept: scored(predict(docs, on, kept), gold).agg(F.avg("score").alias("score")).select(F.lit(name).alias("base"), "score")

    return audit.ablation(audit.ablate(runs("a"), rules).unionByName(audit.ablate(runs("b"), rules)))


def compared(docs: DataFrame, before: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, before, after): documents for which two revisions of predict give other lists of predictions."""
    columns = ["start", "end", "class", "record_id", "confidence"]
    one, two = (audit.listed(f(docs).withColumn("confidence", F.round("confidence", 4)), docs, columns) for f in (before, after))
    return audit.changed(one, two, ["predictions"])
