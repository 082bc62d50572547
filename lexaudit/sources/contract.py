"""Outputs: contract JSON and submission cells, one a document."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.family import kind


def cell(start: Column, end: Column, class_: Column, record_id: Column, confidence: Column) -> Column:
    """One citation of a submission cell; a dash for a missing (or zero) id and for a missing confidence."""
    number = F.when(record_id.isNull() | (record_id == 0), F.lit("-")).otherwise(record_id.cast("string"))
    sure = F.when(confidence.isNull(), F.lit("-")).otherwise(F.format_string("%.4f", confidence))
    return F.concat_ws(",", start.cast("string"), end.cast("string"), class_, number, sure)


def gold_cell(start: Column, end: Column, class_: Column, record_id: Column) -> Column:
    """One citation of a gold cell."""
    return F.concat_ws(",", start.cast("string"), end.cast("string"), class_, F.coalesce(record_id.cast("string"), F.lit("-")))


def cells(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(documento_id, citacoes): citations in order, joined by a bar; a dash for a document without any."""
    one = resolved.select("doc_id", F.struct("idx", cell(*(F.col(c) for c in ("start", "end", "class", "record_id", "confidence"))).alias("cell")).alias("c"))
    listed = one.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cell"]), "|").alias("citacoes"))
    return docs.select("doc_id").join(listed, "doc_id", "left").select(F.col("doc_id").alias("documento_id"), F.coalesce("citacoes", F.lit("-")).alias("citacoes"))


def contract(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(documento_id, json) in the contract's form; keys without a value are absent."""
    entry = F.struct(
        "idx",
        F.struct(
            F.col("start").alias("inicio"),
            F.col("end").alias("fim"),
            F.col("snippet").alias("trecho"),
            kind(F.col("snippet")).alias("tipo"),
            F.col("class").alias("classificacao"),
            F.col("confidence").alias("confianca"),
            F.when(F.col("record_id").isNotNull(), F.struct(F.col("record_id").cast("string").alias("id_canonico"))).alias("resolucao"),
        ).alias("c"),
    )
    listed = resolved.select("doc_id", entry.alias("e")).groupBy("doc_id").agg(F.transform(F.array_sort(F.transform(F.collect_list("e"), lambda e: F.struct(e["idx"].alias("i"), F.to_json(e["c"]).alias("j")))), lambda e: e["j"]).alias("items"))
    joined = docs.select("doc_id").join(listed, "doc_id", "left")
    name = F.to_json(F.struct(F.col("doc_id").cast("string").alias("documento_id")))
    body = F.concat(F.expr("substring(n, 1, length(n) - 1)"), F.lit(',"citacoes":['), F.coalesce(F.array_join("items", ","), F.lit("")), F.lit("]}"))
    return joined.withColumn("n", name).select(F.col("doc_id").alias("documento_id"), body.alias("json"))


def write_csv(submission: DataFrame, path: str) -> None:
    """The submission as one CSV file with a header, in order of documents."""
    submission.orderBy("documento_id").coalesce(1).write.csv(path, header=True)


def write_json(documents: DataFrame, path: str) -> None:
    """Contract documents as JSON lines, in parallel."""
    documents.select(F.col("json").alias("value")).write.text(path)


def write_pretty(documents: DataFrame, folder: str) -> None:
    """One indented JSON file a document, as <folder>/<id>.json on a file system that pyarrow opens; made whole before it gets its name."""

    def run(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        where.create_dir(inner, recursive=True)
        for row in rows:
            data = json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2) + "\n"
            final = f"{inner}/{row['documento_id']}.json"
            with where.open_output_stream(f"{final}.part") as out:
                out.write(data.encode())
            where.move(f"{final}.part", final)

    documents.select("documento_id", "json").foreachPartition(run)
