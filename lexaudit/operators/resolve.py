"""Decision of each citation: real, fabricated or incomplete, and by which rule.

Hits are reduced to one slim row a record, gathered a citation (at most the
cap times its identifiers), and decided by one expression. Only citations
that no rule decides go to a chooser, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.family import family, family_at, files
from ..functions.identifiers import identifiers
from ..functions.text import collapse
from . import prompts
from .models import Answerer
from .normindex import look_up
from .textindex import HEADER_LIMIT, candidates, exchanged

#: Header hits whose positions differ by this much at most are copies of one decision (fixed value).
COPY_TOLERANCE = 2
#: Characters of a record that a chooser sees (fixed value).
OPTION_CHARS = 200
#: Confidence that each path declares (fixed values).
CONFIDENCE = {
    "normativo": 1.0,
    "sem_identificador": 1.0,
    "registro_unico": 1.0,
    "sem_candidato": 1.0,
    "cabecalho": 1.0,
    "especie": None,
    "desempate": None,
    "so_mencionado": None,
    "especie_ilegivel": None,
    "ambiguo": None,
}
KEY = ["doc_id", "idx"]


def confidence(path: Column) -> Column:
    """Confidence of a path; null where it declares none."""
    return F.coalesce(*[F.when(path == p, F.lit(c)) for p, c in CONFIDENCE.items() if c is not None])


def one_per_record(hits: DataFrame) -> DataFrame:
    """Of each citation and record the earliest hit; equal ones by the rest of the row."""
    rest = [c for c in hits.columns if c not in (*KEY, "record_id", "position")]
    best = hits.groupBy(*KEY, "record_id").agg(F.min(F.struct("position", *rest)).alias("best"))
    return best.select(*KEY, "record_id", "best.*")


def _decision(kind: str, path: str, record: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("class"), (F.lit(None) if record is None else record).cast("long").alias("record_id"), F.lit(path).alias("path"))


def decide(hits: Column, cited: Column) -> Column:
    """struct(class, record_id, path) of a citation with two records or more, or null if a chooser must decide.

    hits: array of struct(position, record_id, family, files), sorted.
    """
    first = lambda a: F.get(a, F.lit(0))
    header = F.filter(hits, lambda h: h["position"] < HEADER_LIMIT)
    copies = F.filter(header, lambda h: F.abs(h["position"] - first(header)["position"]) <= COPY_TOLERANCE)
    filing = F.filter(header, lambda h: h["files"])
    same = F.filter(hits, lambda h: h["family"] == cited)
    filed = F.filter(same, lambda h: h["files"])
    by_place = (
        F.when(F.size(copies) > 1, _decision("real", "registro_unico", F.array_min(F.transform(copies, lambda h: h["record_id"]))))
        .when(F.size(header) == 1, _decision("real", "cabecalho", first(header)["record_id"]))
        .when(F.size(filing) == 1, _decision("real", "especie", first(filing)["record_id"]))
    )
    by_family = (
        F.when(cited.isNull(), _decision("real", "especie_ilegivel", first(hits)["record_id"]))
        .when(F.size(same) == 0, _decision("inventada", "so_mencionado"))
        .when(F.size(filed) == 1, _decision("real", "especie", first(filed)["record_id"]))
        .otherwise(_decision("real", "especie", first(same)["record_id"]))
    )
    return F.when(F.size(header) > 0, by_place).otherwise(by_family)


def _ruled(citations: DataFrame, hits: DataFrame, texts_too: bool) -> DataFrame:
    """The citations with their hits, and d: what the rules decide, null for a dispute."""
    slim = one_per_record(hits.select(*KEY, "record_id", "position", "family", "files", *(["text"] if texts_too else [])))
    texts = [F.substring("text", 1, OPTION_CHARS).alias("text")] if texts_too else []
    listed = slim.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("position", "record_id", "family", "files", *texts))).alias("hits"))
    rows = citations.join(exchanged(listed), KEY, "left")
    n = F.when(F.col("hits").isNull(), F.lit(0)).otherwise(F.size("hits"))
    rule = (
        F.when(F.col("normative") & F.col("norm_id").isNotNull(), _decision("real", "normativo", F.col("norm_id")))
        .when(F.col("normative"), _decision("inventada", "normativo"))
        .when(F.col("n_identifiers") == 0, _decision("incompleta", "sem_identificador"))
        .when(n == 1, _decision("real", "registro_unico", F.get("hits", F.lit(0))["record_id"]))
        .when((n == 0) & F.col("ambiguous"), _decision("incompleta", "ambiguo"))
        .when(n == 0, _decision("inventada", "sem_candidato"))
        .otherwise(decide(F.col("hits"), F.col("family")))
    )
    return rows.withColumn("d", rule)


def resolve_hits(citations: DataFrame, hits: DataFrame, chooser: Answerer | None = None, prompt: prompts.Prompt | None = None) -> DataFrame:
    """(doc_id, idx, class, record_id, confidence, path) of every citation.

    citations: doc_id, idx, snippet, family, normative, norm_id, n_identifiers,
    ambiguous. hits: doc_id, idx, record_id, position, family, files (and text,
    if a chooser is given). Without a chooser disputes go to the first record.
    """
    decided = _ruled(citations, hits, chooser is not None)
    if chooser is None:
        stub = _decision("real", "desempate", F.get("hits", F.lit(0))["record_id"])
        decided = decided.withColumn("d", F.coalesce("d", stub))
    else:
        open_ = decided.where("d is null").select(*KEY, "snippet", "hits")
        chosen = choose(open_, chooser, prompt).withColumnRenamed("choice", "picked")
        decided = decided.join(exchanged(chosen), KEY, "left")
        picked = F.when(F.col("picked") < 0, _decision("inventada", "so_mencionado")).otherwise(_decision("real", "desempate", F.get("hits", F.col("picked"))["record_id"]))
        decided = decided.withColumn("d", F.coalesce("d", picked))
    return decided.select(*KEY, "d.class", "d.record_id", confidence(F.col("d.path")).alias("confidence"), "d.path")


def options(texts: Column) -> Column:
    """Numbered list of what each record begins with, one a line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), collapse(F.substring(t, 1, OPTION_CHARS)))), "\n")


def answer_index(answer: Column, total: Column) -> Column:
    """Index from 0 that an answer picks: its first run of digits; -1 for 0; the first if none or too large."""
    number = F.regexp_extract(answer, r"(\d+)", 1)
    choice = F.when(number == "", F.lit(0)).when(F.length(number) > 9, F.lit(999_999_999)).otherwise(F.substring(number, 1, 9).try_cast("int") - 1)
    return F.when(choice == -1, F.lit(-1)).when(choice < total, choice).otherwise(F.lit(0)).cast("int")


def questions(disputes: DataFrame, prompt: prompts.Prompt | None = None) -> DataFrame:
    """(doc_id, idx, prompt, system, question, total) of disputes (snippet, hits with text); prompt is the label of its version."""
    used = prompt or prompts.current("choice")
    filled = F.replace(F.replace(F.lit(used.template), F.lit("{citation}"), collapse(F.col("snippet"))), F.lit("{options}"), options(F.col("hits.text")))
    return disputes.select(*KEY, F.lit(used.label).alias("prompt"), F.lit(used.system).alias("system"), filled.alias("question"), F.size("hits").alias("total"))


def disputes(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, idx, snippet, hits) of the citations that no rule decides."""
    return _ruled(citations, hits, True).where("d is null").select(*KEY, "snippet", "hits")


def choose(disputed: DataFrame, chooser: Answerer, prompt: prompts.Prompt | None = None) -> DataFrame:
    """(doc_id, idx, choice): the chooser's pick for each dispute (snippet, hits with text); it is not called without disputes."""
    asked = questions(disputed, prompt)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(answer=chooser(part["system"].iloc[0], part["question"].tolist()))[[*KEY, "answer", "total"]]

    schema = f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, idx int, answer string, total int"
    return asked.mapInPandas(run, schema).select(*KEY, answer_index(F.col("answer"), F.col("total")).alias("choice"))


def gather(citations: DataFrame, counts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations (doc_id, idx, snippet, ids) with n_identifiers and ambiguous, and their hits.

    A citation is ambiguous if some identifier was in too many records and none was decisive.
    """
    asked = citations.select(*KEY, F.explode("ids").alias("phrase"))
    judged = asked.join(exchanged(counts), "phrase", "left").groupBy(*KEY).agg(F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("over"), F.bool_or(~F.coalesce("ambiguous", F.lit(False))).alias("decisive"))
    flagged = citations.join(exchanged(judged), KEY, "left").withColumn("ambiguous", F.coalesce(F.col("over") & ~F.col("decisive"), F.lit(False)))
    return flagged.withColumn("n_identifiers", F.size("ids")).drop("over", "decisive"), asked.join(exchanged(found), "phrase")


def found_hits(citations: DataFrame, registry: DataFrame, postings: DataFrame, norms: DataFrame, texts_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """Citations (doc_id, idx, snippet) as resolve_hits takes them, and their hits in a registry, its index and its normative index.

    Identifiers are looked up once each, however many citations name them.
    Citations with their identifiers are kept (in memory or on disk), so that
    extraction runs once; spark.catalog.clearCache() lets them go.
    """
    looked = look_up(citations.select(*KEY, "snippet"), norms).withColumn("family", family(F.col("snippet")))
    looked = looked.withColumn("ids", F.when(F.col("normative"), F.array().cast("array<string>")).otherwise(identifiers(F.col("snippet")))).persist()
    counts, found = candidates(registry, postings, looked.select(F.explode("ids").alias("phrase")).distinct())
    read = found.select("phrase", "record_id", "position", family_at(F.col("text"), F.col("start")).alias("family"), files(F.col("text"), F.col("start")).alias("files"), *(["text"] if texts_too else []))
    return gather(looked, counts, read)


def verify(citations: DataFrame, registry: DataFrame, postings: DataFrame, norms: DataFrame, chooser: Answerer | None = None, prompt: prompts.Prompt | None = None) -> DataFrame:
    """Resolutions of citations (doc_id, idx, snippet); see found_hits and resolve_hits."""
    return resolve_hits(*found_hits(citations, registry, postings, norms, chooser is not None), chooser, prompt)
