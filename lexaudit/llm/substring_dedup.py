"""Substring deduplication by sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` or ``?`` that white space
follows, and at line breaks; a single word is no sentence of its own and goes
with what follows it. Every run of RUN consecutive sentences is a span. Spans
are hashed (96 bits, from the hashes of their sentences) and joined globally; a
sentence is removed if any span that covers it is not the first of its hash,
in the order of doc_id and place in the text.

A repeated passage may have fewer whole sentences. So runs of one sentence up
to RUN - 1 are spans too, if they have LONG_WORDS words, and a further count
and text leave out what either kind of span covers; the count and the text
that are named first go by runs of RUN sentences alone.

Defined results: white space is collapsed before hashing and otherwise bytes
must agree; a null or empty text has no sentences and stays as it is; a text
that is shorter than any span keeps all its sentences; what ends a text is a
sentence, however short; rows that share a doc_id have all that is removed from
that doc_id removed from each; a row without doc_id keeps its text and is no
first occurrence; of equal spans in one text the first stays; a very long text
is cut whole by one task; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, materialize, returned
from .tokens import mix, passes

#: Sentences of a span.
RUN = 3
#: Words of a sentence, at least.
LEAST_WORDS = 2
#: Words of a span of fewer than RUN sentences, at least.
LONG_WORDS = 20

_CUT = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> tuple[list[int], list[bytes]]:
    """Where each sentence starts, with the white space behind it part of it, then the end; and each one's words."""
    starts, words, held = [0], [], []
    begin = 0
    for m in _CUT.finditer(text):
        held += text[begin : m.start()].split()
        begin = m.end()
        if len(held) >= LEAST_WORDS:
            starts.append(begin)
            words.append(" ".join(held).encode())
            held = []
    held += text[begin:].split()
    if starts[-1] < len(text):
        starts.append(len(text))
        words.append(" ".join(held).encode())
    return starts, words


def spans(texts: list[str], run: int, words: int) -> tuple[np.ndarray, ...]:
    """(text, place, sentences, 64 bits, 32 bits, again) of every span of the texts; again: its text had it before."""
    found = [sentences(t)[1] for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for said in found for w in said), "<u8").reshape(-1, 2)
    n_words = np.array([w.count(b" ") + bool(w) for said in found for w in said], np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    h1, h2, total = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), np.zeros(len(row), np.int64)
    start, parts = np.arange(len(row)), []
    for size in range(1, run + 1):
        fits = place[start] + size <= counts[row[start]]
        start, h1, h2, total = start[fits], h1[fits], h2[fits], total[fits]
        last = start + size - 1
        h1, h2, total = mix(h1 + hashes[last, 0]), mix(h2 + hashes[last, 1]), total + n_words[last]
        taken = np.flatnonzero((total >= words) | (size == run))
        parts.append((start[taken], np.full(len(taken), size, np.int8), h1[taken], h2[taken]))
    start, sizes, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
    row, place, again = row[start], place[start], np.zeros(len(start), bool)
    order = np.lexsort((place, low, h1, row))
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (row, h1, low)])
    again[order[1:][same]] = True
    return row, place, sizes, h1.view(np.int64), low, again


def span_rows(docs: DataFrame, run: int = RUN, words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, place, size, h1, h2, again) of every span; again: the text had it before."""
    bounded_batches(docs.sparkSession)

    @returned
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False), [x or "" for x in batch.column("text").to_pylist()]
            for a, b in passes(texts):
                row, place, sizes, h1, h2, again = spans(texts[a:b], run, words)
                columns = [ids[a:b][row], place.astype(np.int32), sizes, h1, h2, again]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "place", "size", "h1", "h2", "again"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(made, "doc_id long, place int, size byte, h1 long, h2 int, again boolean")


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, place, size) of the spans that are not the first of their hash."""
    once = found.where("not again").select("doc_id", "place", "size", "h1", "h2")
    firsts = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("h1", "h2", "first_id")
    later = once.join(firsts, ["h1", "h2"]).where("doc_id > first_id").select("doc_id", "place", "size")
    return later.union(found.where("again").select("doc_id", "place", "size"))


def deduplicate(docs: DataFrame, run: int = RUN, words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text, n_repeated, text_left) of every row.

    text is without the n_removed sentences that runs of run sentences repeat;
    text_left without the n_repeated ones that these or shorter runs of the
    words repeat.
    """
    gone = repeated(materialize(span_rows(docs, run, words), "spans"))
    listed = gone.groupBy("doc_id").agg(F.collect_set(F.struct("place", "size")).alias("gone"))

    @returned
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, left = [], {run: [], 1: []}, {run: [], 1: []}
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                starts = sentences(text or "")[0]
                counts.append(len(starts) - 1)
                for least in removed:
                    drop = {i for x in gone or () if x["size"] >= least for i in range(x["place"], min(x["place"] + x["size"], len(starts) - 1))}
                    removed[least].append(len(drop))
                    left[least].append("".join(text[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if i not in drop) if drop else text)
            columns = [pa.array(counts, pa.int64()), *(x for least in (run, 1) for x in (pa.array(removed[least], pa.int64()), pa.array(left[least], pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_sentences", "n_removed", "text", "n_repeated", "text_left"])

    joined = docs.select("doc_id", "text").join(listed, "doc_id", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(kept, "doc_id long, n_sentences long, n_removed long, text string, n_repeated long, text_left string")
