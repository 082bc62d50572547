"""Citation spans of documents: candidates of all forms, filtered and deduplicated in one pass over Arrow batches.

The forms themselves are read by ``citations``; where the body of a text
starts is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import preamble_end
from . import citations
from .spans import keep_longest

#: Rules of extraction that can be switched off one by one.
RULES = frozenset(citations.FORMS) | {"quantity", "label", "preamble", "dedup"}


def spans_of(text: str, rules: frozenset[str] = RULES, body: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the citations of one text that start at body or later; by place if they are deduplicated."""
    found = [s for s in citations.spans(text, rules, "quantity" in rules, "label" in rules) if s[0] >= body]
    return keep_longest(found) if "dedup" in rules else found


def extract(docs: DataFrame, rules: frozenset[str] = RULES, key: str = "doc_id") -> DataFrame:
    """(doc_id, idx, start, end, snippet): the citations of each document, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, idx, starts, ends, snippets = [], [], [], [], []
            for row, (text, body) in enumerate(zip(batch.column("text").to_pylist(), batch.column("body").to_pylist(), strict=True)):
                for i, (start, end) in enumerate(spans_of(text, rules, body) if text else ()):
                    rows.append(row)
                    idx.append(i)
                    starts.append(start)
                    ends.append(end)
                    snippets.append(text[start:end])
            ints = [pa.array(x, pa.int32()) for x in (idx, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *ints, pa.array(snippets, pa.string())], [key, "idx", "start", "end", "snippet"])

    body = preamble_end(F.col("text")) if "preamble" in rules else F.lit(0)
    made = [StructField(n, IntegerType()) for n in ("idx", "start", "end")] + [StructField("snippet", StringType())]
    return docs.select(key, "text", body.alias("body")).mapInArrow(run, StructType([StructField(key, docs.schema[key].dataType), *made]))
