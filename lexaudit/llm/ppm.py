"""Language-model scores by prediction by partial matching (PPM) over bytes.

A trie of byte contexts, up to five bytes long, is pretrained on the training
texts. A byte is predicted in the longest context that training saw; where it
was not seen there, the model escapes to the next shorter context, with the
symbols of the longer one excluded. A context of n occurrences with d distinct
successors gives a symbol of count c the probability c / (n + d) and escape
d / (n + d) (method C); after an escape both n and d count only symbols not
excluded. Below the empty context all symbols not yet seen are equally likely.
An end symbol (0xFF, which UTF-8 never has) closes each text, and 0xFE stands
before its first byte.

Texts stay in chunks. A chunk sends its distinct strings of six bytes, with
training counts, to buckets by the last two bytes of context; a bucket holds
every string of these contexts, so it has the trie's nodes of order two to
five whole, and answers each chunk with log-probabilities. Orders one and
zero are a table of at most 65,536 counts, which every bucket gets. Counts of
words, for the base score, are exchanged in the same way. The trie is never
in one place, and all that is gathered grows with the distinct strings.

Defined results: a null text counts as empty and scores its end alone; rows
without doc_id are training rows; any long is a doc_id; repeated rows are
trained on and scored each; without training rows every symbol has probability
1/256; a very long text is a chunk of its own, scored whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, pack_bytes, pack_keys, pack_planes, packed_ids, unpack_bytes, unpack_keys, unpack_planes
from .store import bounded_batches, materialize, partitions, returned
from .tokens import mix, passes, texts_of, word_hashes

#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 16_000_000
ORDER, START, END = 5, b"\xfe", b"\xff"
GRAMS, WORDS, TEXTS = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The string of ORDER + 1 bytes that ends at each symbol, and the index of each text's first one (one more at the end)."""
    buf = np.frombuffer(b"".join(START * ORDER + x + END for x in texts), np.uint8)
    out = np.zeros(len(buf) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | buf[k : len(buf) - ORDER + k]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    own = np.arange(at[-1]) + np.repeat(np.arange(len(texts)) * ORDER, np.diff(at))
    return out[own], at


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


class Counts:
    """Distinct keys of many passes with their counts in training; a pass is counted as it comes, and what it adds is summed up before it outgrows half of what is there."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, train: bool) -> None:
        """Count the keys of a pass, as 0 unless they are of training."""
        found, n = np.unique(keys, return_counts=True)
        self.held.append((found, n * train))
        if sum(len(x) for x, _ in self.held) > len(self.keys) // 2:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys so far, ascending, and their counts."""
        if self.held:
            keys, counts = summed(np.concatenate([x for x, _ in self.held]), np.concatenate([n for _, n in self.held]))
            self.held = []
            at = np.searchsorted(self.keys, keys)
            old = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            old[inside] = self.keys[at[inside]] == keys[inside]
            self.counts[at[old]] += counts[old]
            self.keys = np.insert(self.keys, at[~old], keys[~old])
            self.counts = np.insert(self.counts, at[~old], counts[~old])
        return self.keys, self.counts


def _by_bucket(of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def _bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    if kind == GRAMS:
        keys = mix((keys >> np.uint64(8)) & np.uint64(0xFFFF))
    return (keys % np.uint64(buckets)).astype(np.int64)


def block(table: pa.Table, chunk: int, buckets: int) -> pa.RecordBatch:
    """The rows of a chunk (doc_id, text, held_out), as gather has them."""
    texts = texts_of(table.column("text").combine_chunks())
    train = ~np.array(table.column("held_out").to_pylist(), bool)
    parts = {GRAMS: Counts(), WORDS: Counts()}
    tokens = 0
    for flag in (True, False):
        some = [x for x, t in zip(texts, train, strict=True) if t == flag]
        for a, b in passes(some):
            hashes, _ = word_hashes(some[a:b])
            tokens += (len(hashes) + b - a) * flag
            parts[GRAMS].add(grams(some[a:b])[0], flag)
            parts[WORDS].add(hashes, flag)
    rows = []
    for kind in (GRAMS, WORDS):
        keys, counts = parts.pop(kind).sum()
        if kind == GRAMS:
            pairs, times = summed(keys & np.uint64(0xFFFF), counts)
        for b, own in _by_bucket(_bucket_of(kind, keys, buckets), buckets):
            rows.append((chunk, kind, b, pack_keys(keys[own]), pack_planes(counts[own]), None, None))
    total = pack_bytes([pack_planes(pairs.astype(np.int64)), pack_planes(times), pack_planes(np.array([tokens, train.sum()], np.int64))])
    held = pack_bytes([*(pack_planes(x) for x in packed_ids(table.column("doc_id"))), pack_planes(train), pack_bytes(texts)])
    rows.append((chunk, TEXTS, -1, None, None, total, held))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["chunk", "kind", "bucket", "keys", "counts", "pairs", "texts"])


def gather(docs: DataFrame, buckets: int, size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, kind, bucket, keys, counts, pairs, texts): what each chunk asks and counts, and its texts, in the shared folder."""
    bounded_batches(docs.sparkSession)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, table in enumerate(chunks(batches, size)):
            yield block(table, part * 1_000_000 + no, buckets)

    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return materialize(given.mapInArrow(run, "chunk long, kind int, bucket int, keys binary, counts binary, pairs binary, texts binary"), "ppm-blocks")


def low_orders(blocks: DataFrame) -> tuple[np.ndarray, int, int]:
    """Counts of (context byte, symbol) as a 256 x 256 table, training tokens, and training texts."""

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                pairs, times, rest = (unpack_planes(x, np.int64) for x in unpack_bytes(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs, [-1, -2]])), pa.array(np.concatenate([times, rest]))], ["pair", "n"])

    sums = blocks.where("pairs is not null").select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(sums["pair"].tolist(), sums["n"].tolist(), strict=True))
    table = np.zeros(1 << 16, np.int64)
    for pair, n in found.items():
        if pair >= 0:
            table[pair] = n
    return table.reshape(256, 256), found.get(-1, 0), found.get(-2, 0)


def _log(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10(x / y), and 0 where x is 0: an escape that is certain, or a case that no one asks for."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((x > 0) & (y > 0), np.log10(np.maximum(x, 1) / np.maximum(y, 1)), 0.0)


def _low(c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the (byte, symbol) table: log-probabilities when order one is the first, those after an escape from it, totals and distinct symbols."""
    c0 = c1.sum(0)
    n0, d0 = c0.sum(), int((c0 > 0).sum())
    below = -np.log10(max(1, 256 - d0))
    first0 = np.where(c0 > 0, _log(c0, n0 + d0), _log(np.array(d0), np.array(n0 + d0)) + below)
    n1, d1 = c1.sum(1), (c1 > 0).sum(1)
    left_n, left_d = n0 - ((c1 > 0) @ c0), d0 - d1
    whole = (left_n + left_d)[:, None]
    after1 = np.where(c0[None, :] > 0, _log(np.broadcast_to(c0, (256, 256)), whole), _log(left_d[:, None], whole) + below)
    own, escape = _log(c1, (n1 + d1)[:, None]), _log(d1, n1 + d1)[:, None]
    first1 = np.where(n1[:, None] == 0, first0[None, :], np.where(c1 > 0, own, escape + after1))
    return first1, after1, n1, d1


def log_probabilities(keys: np.ndarray, counts: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """log10 P(last byte | the five before) of ascending distinct strings.

    The strings must be all, of training or asked for, whose contexts end in
    the same two bytes; counts are those in training.
    """
    levels = [(keys, counts, None)]
    for k in range(ORDER - 1, 1, -1):
        short = levels[-1][0] & np.uint64(256 ** (k + 1) - 1)
        found, up = np.unique(short, return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, up, levels[-1][1])
        levels.append((found, n, up))
    first1, after1, n1, d1 = _low(c1)
    low = levels[-1][0]
    byte, symbol = ((low >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (low & np.uint64(255)).astype(np.int64)
    c_low, n_low, d_low, first_low, after_low = c1[byte, symbol], n1[byte], d1[byte], first1[byte, symbol], after1[byte, symbol]
    for level in range(len(levels) - 1, -1, -1):
        own, c, _ = levels[level]
        context = own >> np.uint64(8)
        node = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]])) if len(own) else np.zeros(0, np.int64)
        size = int(node[-1]) + 1 if len(own) else 0
        n, d, excluded = (np.bincount(node, x, size)[node].astype(np.int64) for x in (c, c > 0, np.where(c > 0, c_low, 0)))
        left_n, left_d = n_low - excluded, d_low - d
        after = np.where(c_low > 0, _log(c_low, left_n + left_d), _log(left_d, left_n + left_d) + after_low)
        first = np.where(n == 0, first_low, np.where(c > 0, _log(c, n + d), _log(d, n + d) + after))
        if level:
            up = levels[level][2]
            c_low, n_low, d_low, first_low, after_low = c[up], n[up], d[up], first[up], after[up]
    return first


def answers(blocks: DataFrame, c1: np.ndarray) -> DataFrame:
    """(chunk, kind, bucket, values, distinct): a value for each key that a chunk asked, and on one row a bucket its distinct training words."""

    def run(table: pa.Table) -> pa.Table:
        kinds, asked = np.array(table.column("kind").to_pylist()), [unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts, values, distinct = [unpack_planes(x, np.int64) for x in table.column("counts").to_pylist()], [b""] * len(asked), np.zeros(len(asked), np.int64)
        for kind in (GRAMS, WORDS):
            rows = np.flatnonzero(kinds == kind)
            if not len(rows):
                continue
            keys, n = summed(np.concatenate([asked[i] for i in rows]), np.concatenate([counts[i] for i in rows]))
            value = log_probabilities(keys, n, c1).astype(np.float32) if kind == GRAMS else n
            for i in rows:
                values[i] = pack_planes(value[np.searchsorted(keys, asked[i])])
            if kind == WORDS:
                distinct[rows[0]] = (n > 0).sum()
        return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"), "values": pa.array(values, pa.binary()), "distinct": pa.array(distinct)})

    asked = blocks.where(F.col("kind") != TEXTS).select("chunk", "kind", "bucket", "keys", "counts")
    return materialize(asked.groupBy("bucket").applyInArrow(run, "chunk long, kind int, bucket int, values binary, distinct long"), "ppm-answers")


def score(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    blocks = gather(docs, partitions(docs.sparkSession), size)
    c1, tokens, training = low_orders(blocks)
    told = answers(blocks, c1)
    distinct = (told.agg(F.sum("distinct")).first()[0] or 0) + (training > 0)
    whole = tokens + distinct + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data = next(x for x in left.column("texts").to_pylist() if x is not None)
        doc_ids, given, train, texts = unpack_bytes(data)
        doc_ids, given, train, texts = unpack_planes(doc_ids, np.int64), unpack_planes(given, bool), unpack_planes(train, bool), unpack_bytes(texts)
        values = {(k, b): v for k, b, v in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "values")), strict=True)}
        tables = {}
        for kind, type_ in ((GRAMS, np.float32), (WORDS, np.int64)):
            keys, found = [np.zeros(0, np.uint64)], [np.zeros(0, type_)]
            for k, b, x in zip(*(left.column(c).to_pylist() for c in ("kind", "bucket", "keys")), strict=True):
                if k == kind:
                    keys.append(unpack_keys(x))
                    found.append(unpack_planes(values[k, b], type_))
            keys, found = np.concatenate(keys), np.concatenate(found)
            order = np.argsort(keys)
            tables[kind] = keys[order], found[order]
        n_tokens, n_known = np.ones(len(texts), np.int64), np.full(len(texts), int(training > 0), np.int64)
        base, model = np.full(len(texts), np.log10((training + 1) / whole)), np.zeros(len(texts))
        for a, b in passes(texts):
            found, at = grams(texts[a:b])
            keys, value = tables[GRAMS]
            model[a:b] = np.add.reduceat(value[np.searchsorted(keys, found)].astype(np.float64), at[:-1])
            hashes, first = word_hashes(texts[a:b])
            keys, value = tables[WORDS]
            c = value[np.searchsorted(keys, hashes)] if len(hashes) else np.zeros(0, np.int64)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                begin = first[:-1][full]
                base[a + full] += np.add.reduceat(np.log10((c + 1) / whole), begin)
                n_known[a + full] += np.add.reduceat((c > 0).astype(np.int64), begin)
            n_tokens[a:b] += np.diff(first)
        known = [x if k else None for x, k in zip(doc_ids.tolist(), given.tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(known, pa.int64()), "held_out": pa.array(~train), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": pa.array(np.full(len(texts), tokens)), "base_score": base, "score": model})

    left = blocks.select("chunk", "kind", "bucket", "keys", "texts").groupBy("chunk")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.cogroup(told.select("chunk", "kind", "bucket", "values").groupBy("chunk")).applyInArrow(run, schema)
