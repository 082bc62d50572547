"""Inputs: folders of text files, registries, gold tables with a byte-order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): one row a .txt file, the stem as id, line ends as LF."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return found.select(F.regexp_replace(name, r"\.txt$", "").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def registry(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """(row_id, record_id, court, nature, text) of a registry table, from any source that Spark reads."""
    return spark.read.format(format).options(**options).load(path).select("row_id", "record_id", "court", "nature", "text")


def registry_from_sqlite(spark: SparkSession, path: str, folder: str, block: int = 10_000) -> DataFrame:
    """The registry of an SQLite file (table documentos), exported once on the driver's machine.

    Blocks of rows go to folder (a path or URI that pyarrow and Spark both
    open) as Parquet files, one at a time, and are read back from there.
    """
    import sqlite3

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    where.create_dir(inner, recursive=True)
    kinds = pa.schema([("row_id", pa.int64()), ("record_id", pa.int64()), ("court", pa.string()), ("nature", pa.string()), ("text", pa.string())])
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    rows = con.execute("SELECT rowid, id, tribunal, natureza, texto FROM documentos")
    no = 0
    while (part := rows.fetchmany(block)) or not no:
        columns = [pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), kinds, strict=True)] if part else [pa.array([], f.type) for f in kinds]
        pq.write_table(pa.table(columns, schema=kinds), f"{inner}/part-{no:06d}.parquet", filesystem=where)
        no += 1
    con.close()
    return registry(spark, folder)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, citation_id, line, start, end, class, record_id, level) of a gold CSV; a byte-order mark is dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return named.select(
        F.col("documento_id").alias("doc_id"),
        F.col("citacao_id").alias("citation_id"),
        F.monotonically_increasing_id().alias("line"),
        F.col("inicio").cast("int").alias("start"),
        F.col("fim").cast("int").alias("end"),
        F.col("classificacao").alias("class"),
        F.regexp_extract("id_canonico", r"^\s*([+-]?\d+)(?:\.0*)?\s*$", 1).try_cast("long").alias("record_id"),
        F.col("nivel").cast("int").alias("level"),
    )
