"""Span algebra: generation, overlap, conflict, pairs and greedy deduplication.

Spans are half-open ranges of code points, counted from 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int,snippet:string>>"
#: Matches whose offsets are added up together.
CELL = 64


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,snippet>> of all matches, in the JVM.

    Matches are wrapped in control characters, the text is split at them, and
    lengths are added up, so that offsets count code points. Sums are taken
    within parts of CELL matches and then over the parts, so that no array of
    all matches grows one by one. The characters U+0001 and U+0002 of the text
    itself count as spaces.
    """
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, f"(?:{pattern})", f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    lead = F.length(F.get(pieces, F.lit(0)))
    count = F.size(pieces) - 1
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.floor((count - 1) / CELL).cast("int")), lambda i: F.slice(pieces, i * CELL + 2, F.least(F.lit(CELL), count - i * CELL))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        snippet = F.substring_index(piece, _CLOSE, 1)
        end = state["at"] + F.length(snippet)
        one = F.array(F.struct(state["at"].alias("start"), end.alias("end"), snippet.alias("snippet")))
        return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.concat(state["found"], one).alias("found"))

    local = F.transform(parts, lambda part: F.aggregate(part, empty, step))
    return F.coalesce(_shifted(local, lead), F.array().cast(SPAN))


def _shifted(local: Column, lead: Column) -> Column:
    """The parts' spans in one array, each part moved behind the ones before."""
    zero = F.struct(lead.alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(local, zero, lambda s, part: F.struct((s["at"] + part["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
    moved = F.zip_with(local, starts, lambda part, at: F.transform(part["found"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["snippet"].alias("snippet"))))
    return F.flatten(moved)


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union, 0 where the spans are disjoint."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(both == 0, F.lit(0.0)).otherwise(both / ((a_end - a_start) + (b_end - b_start) - both))


def conflict(a_start: Column, a_end: Column, b_start: Column, b_end: Column, least: float = 0.5) -> Column:
    """Whether two spans stand for one citation: enough overlap, or one inside the other."""
    inside = ((a_start >= b_start) & (a_end <= b_end)) | ((b_start >= a_start) & (b_end <= a_end))
    return (iou(a_start, a_end, b_start, b_end) >= least) | inside


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str = "doc_id", cell: int = 256) -> DataFrame:
    """Pairs of spans (start, end) of one document that share a character, with their iou.

    Joined on cells of the text and not on the document alone, so that a long
    document costs what overlaps in it; a pair is emitted in the cell where
    its overlap begins. Columns of the sides get the prefixes a_ and b_.
    """

    def cut(df: DataFrame, mark: str) -> DataFrame:
        named = df.select(F.col(key), *(F.col(c).alias(f"{mark}_{c}") for c in df.columns if c != key))
        first, last = F.floor(F.col(f"{mark}_start") / cell), F.floor((F.col(f"{mark}_end") - 1) / cell)
        return named.where(F.col(f"{mark}_end") > F.col(f"{mark}_start")).withColumn("cell", F.explode(F.sequence(first, last)))

    begin = F.greatest("a_start", "b_start")
    meet = (begin < F.least("a_end", "b_end")) & (F.floor(begin / cell) == F.col("cell"))
    joined = cut(left, "a").join(cut(right, "b"), [key, "cell"]).where(meet).drop("cell")
    return joined.withColumn("iou", iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))


def keep_longest(spans: Iterable[tuple[int, int]], least: float = 0.5) -> list[tuple[int, int]]:
    """Greedy: the longest spans first, the earlier of equal ones; a span in conflict with a kept one goes. Ordered by start.

    Kept spans never hold one another, so that the order of their starts is
    that of their ends, and only those that meet a span are compared with it.
    Spans of which none meet are all kept.
    """
    spans = sorted(spans)
    if all(a < b for a, b in spans) and all(a[1] <= b[0] for a, b in pairwise(spans)):
        return spans
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        first, last = bisect_left(ends, start), bisect_right(starts, end)
        for a, b in zip(starts[first:last], ends[first:last], strict=True):
            both = min(end, b) - max(start, a)
            if (start >= a and end <= b) or (both > 0 and both >= least * (end - start + b - a - both)):
                break
        else:
            at = bisect_left(starts, start)
            starts.insert(at, start)
            ends.insert(at, end)
    return list(zip(starts, ends, strict=True))


def deduplicate(df: DataFrame, spans: str = "spans", least: float = 0.5) -> DataFrame:
    """The rows with keep_longest of their array of spans, in one pass over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(spans)
            flat, lengths = lists.flatten(), [x or 0 for x in pc.list_value_length(lists).to_pylist()]
            starts, ends = (flat.field(i).to_pylist() for i in (0, 1))
            chosen, offsets, at = [], [0], 0
            for n in lengths:
                place = {(starts[i], ends[i]): i for i in range(at + n - 1, at - 1, -1)}
                chosen += [place[s] for s in keep_longest(place, least)]
                offsets.append(len(chosen))
                at += n
            kept = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(chosen, pa.int64())))
            yield batch.set_column(batch.schema.get_field_index(spans), spans, kept)

    return df.mapInArrow(run, df.schema)


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row a span: the other columns, idx, start, end, snippet."""
    others = [c for c in df.columns if c != spans]
    return df.select(*others, F.posexplode(spans).alias("idx", "s")).select(*others, "idx", "s.start", "s.end", "s.snippet")
