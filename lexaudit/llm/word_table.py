"""BPE encoding and decoding through a table of distinct words.

Texts are cut into chunks, and each chunk's texts into words by the
tokenizer's own pattern. A chunk keeps the numbers of its words, in order,
and sends each distinct word once to the bucket of its hash. A bucket
encodes each distinct word of all chunks once and answers every chunk; ids
are joined back by position. Decoding joins ids with a table of pieces, whose
size the vocabulary bounds.

Words and numbers leave the chunk in one exchange, numbers by chunk and words
by bucket, which both branches read; answers come back by chunk. Questions of
a bucket stream past its word table, so that memory is that of one chunk, or of
one bucket's distinct words, of which it holds TABLE_WORDS at most (beyond
them, words that come again are encoded again). Numbers of words follow from
the rows of a chunk alone, so that a task that runs again gives them anew.

Defined results: a null or empty text has no ids and decodes to an empty
text; a special token's text is one id, as in the library; repeated rows are
encoded alike; rows without doc_id are encoded too; any long is a doc_id; a
very long text is a chunk of its own; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, pack_bytes, pack_planes, packed_ids, unpack_bytes, unpack_planes
from .store import bounded_batches, partitions, release, returned
from .tokens import _ramp, texts_of
from .words import SpacedEncoder, WordEncoder

#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 4_000_000
#: Distinct words that a bucket remembers.
TABLE_WORDS = 1_000_000
#: Bytes of ids that are decoded at once.
DECODE_BYTES = 500_000
#: The byte-level pattern that the public GPT-2 encoder documents.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Splitter:
    """Cuts texts into words as the tokenizer file says: special tokens first, then the pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        if config["normalizer"] is not None or config["pre_tokenizer"]["type"] != "ByteLevel" or config["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level tokenizers without a normalizer are split here")
        special = sorted((x["content"] for x in config["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = special
        self.find = regex.compile(PATTERN).findall

    def __call__(self, data: bytes) -> list[str]:
        text = data.decode()
        if self.special is None or not any(x in text for x in self.marks):
            return self.find(text)
        return [w for i, part in enumerate(self.special.split(text)) for w in ([part] if i % 2 else self.find(part))]


def _row(key: int, chunk: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["key", "chunk", "data"])


class Blanks:
    """Cuts texts at ASCII white space, for tokenizers whose tokens never cross it and that drop it."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: bytes) -> list[bytes]:
        return text.split()


def split_words(docs: DataFrame, path: str, buckets: int, size: int = CHUNK_BYTES, splitter: type[Splitter] | type[Blanks] = Splitter) -> DataFrame:
    """(key, chunk, data): under the key -1 - bucket a chunk's distinct words of that bucket, and under its own number its documents as word numbers.

    Words are numbered as they appear, so that frequent ones have small numbers.
    Chunks of one partition are numbered in its order, and partitions in theirs.
    """
    bounded_batches(docs.sparkSession)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = splitter(path), TaskContext.get().partitionId()
        for no, table in enumerate(chunks(batches, size)):
            numbers: dict[str | bytes, int] = defaultdict(count().__next__)
            placed = [np.fromiter(map(numbers.__getitem__, split(x)), np.uint32) for x in texts_of(table.column("text").combine_chunks())]
            words = [w if isinstance(w, bytes) else w.encode() for w in numbers]
            of = np.array([zlib.crc32(w) % buckets for w in words], np.uint16)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(buckets + 1))
            chunk = part * 1_000_000 + no
            held = [*packed_ids(table.column("doc_id")), np.array([len(x) for x in placed], np.int64), np.concatenate(placed), of]
            yield _row(chunk, chunk, pack_bytes([pack_planes(x) for x in held]))
            yield from (_row(-1 - b, chunk, pack_bytes([words[i] for i in order[ends[b] : ends[b + 1]]])) for b in range(buckets) if ends[b] < ends[b + 1])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, chunk long, data binary")


def stays(condition: Column) -> Column:
    """The condition, kept above an exchange that two branches share: a filter that looks at the place of a row is not moved below it."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def encoded_chunks(docs: DataFrame, path: str, each: Callable[[int, list[int | None], np.ndarray, np.ndarray], pa.Table], schema: str, size: int = CHUNK_BYTES, splitter: type[Splitter] | type[Blanks] = Splitter) -> DataFrame:
    """What each(chunk, doc_ids, ids, ends) makes of every chunk; ends are where each document's ids end."""
    buckets = min(partitions(docs.sparkSession), 1 << 16)
    dealt = split_words(docs, path, buckets, size, splitter).repartition(buckets, "key")

    @returned
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = None, {}
        for batch in batches:
            for key, chunk, data in zip(*(batch.column(c) for c in ("key", "chunk", "data")), strict=True):
                if key.as_py() >= 0:
                    continue
                encoder = encoder or (SpacedEncoder(path) if splitter is Blanks else WordEncoder(path))
                words = unpack_bytes(data.as_py())
                if len(known) > TABLE_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, encoder.ids(new), strict=True))
                yield _row(key.as_py(), chunk.as_py(), pack_bytes([known[w] for w in words]))

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return each(-1, [], np.zeros(0, np.uint32), np.zeros(0, np.int64)).slice(0, 0)
        answers = sorted(zip(right.column("key").to_pylist(), right.column("data").to_pylist(), strict=True), reverse=True)
        ids = [x for _, data in answers for x in unpack_bytes(data)]
        doc_ids, given, counts, numbers, of = (unpack_planes(x, t) for x, t in zip(unpack_bytes(left.column("data")[0].as_py()), (np.int64, bool, np.int64, np.uint32, np.uint16), strict=True))
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes, at, order = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.argsort(of, kind="stable")
        sizes[order] = [len(x) // 4 for x in ids]
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        ids_of_word = sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(ids_of_word)])[np.cumsum(counts)]
        whole = flat[np.repeat(at[numbers], ids_of_word) + _ramp(ids_of_word)]
        made = each(left.column("chunk")[0].as_py(), [x if k else None for x, k in zip(doc_ids.tolist(), given.tolist(), strict=True)], whole, ends)
        release()
        return made

    answers = dealt.mapInArrow(answer, "key long, chunk long, data binary")
    return dealt.where(stays(F.col("key") >= 0)).groupBy("key").cogroup(answers.groupBy("chunk")).applyInArrow(join_back, schema)


def encode(docs: DataFrame, path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids) of every row; ids are little-endian unsigned 32-bit integers in a binary value."""

    def rows(chunk: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(_cut(ids, ends), pa.binary())})

    return encoded_chunks(docs, path, rows, "doc_id long, ids binary", size)


def round_trip(docs: DataFrame, path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids, text) of every row: encoded, and decoded again while the chunk is held."""

    def rows(chunk: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        cut = _cut(ids, ends)
        texts = Pieces.of(path).texts(cut) if cut else []
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(cut, pa.binary()), "text": pa.array(texts, pa.string())})

    return encoded_chunks(docs, path, rows, "doc_id long, ids binary, text string", size)


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    flat, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    pieces = {i: bytes(of_char[c] for c in token) for token, i in config["model"]["vocab"].items()}
    pieces |= {x["id"]: x["content"].encode() for x in config["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class Pieces:
    """The table of pieces by id, in two arrays; ids of documents are joined with it by their value."""

    def __init__(self, path: str):
        pieces = byte_pieces(path)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    @lru_cache(maxsize=1)
    def of(path: str) -> Pieces:
        """The table of a tokenizer file, loaded once a worker."""
        return Pieces(path)

    def texts(self, ids: list[bytes]) -> list[str]:
        """The text of each run of ids."""
        out = []
        for data in ids:
            parts = []
            for a in range(0, len(data), DECODE_BYTES):
                own = np.frombuffer(data[a : a + DECODE_BYTES], "<u4")
                parts.append(self.flat[np.repeat(self.at[own], self.sizes[own]) + _ramp(self.sizes[own])].tobytes())
            out.append(b"".join(parts).decode("utf-8", "replace"))
        return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows (doc_id, ids) with their text, by a join of ids with pieces, whose table the vocabulary bounds."""
    bounded_batches(encoded.sparkSession)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Pieces.of(path).texts([x or b"" for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
