"""Token ids in files of shuffled planes.

Ids are cut into blocks of a fixed size. A block's ids are transposed into
byte planes (or bit planes), and each plane is compressed with zstandard on
its own. One file is:

    magic "LXPLANE1"
    planes of block 0, planes of block 1, ...
    document table: zstandard of doc_ids (0 for null), then 1 for known ids and 0 for null, then counts of ids (int64 each)
    chunk index: zstandard of a row a block: offset, ids, compressed size of each plane (int64 each)
    footer: 8 int64 (blocks, documents, ids, planes, bit planes or not, offset of the document table, of the chunk index, block size), then the magic

Every number is little-endian. Files hold documents in ascending doc_id
order; a manifest names them in order. A file that a lost or repeated task
wrote is not in the manifest.

Defined results: a null text counts as empty and has the end id alone; a row
without doc_id sorts first; any long is a doc_id; rows that share a doc_id
follow one another by their texts; a very long text is a chunk of its own; an
empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, new_path, partitions, returned
from .word_table import Blanks, encoded_chunks

MAGIC = b"LXPLANE1"
FOOTER = struct.Struct("<8q8s")
BLOCK = 65_536
#: Bytes of text that one file holds the ids of, unless one text is longer; larger than where texts alone are encoded, as each file asks for its distinct words.
CHUNK_BYTES = 16_000_000


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    return [x.tobytes() for x in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The inverse of planes_of for n ids."""
    if not bits:
        raw = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1)
    else:
        each = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in planes], axis=1)
        raw = np.packbits(each, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a plain path."""
    if ":" not in path:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; add documents in order, then close."""

    def __init__(self, path: str, bits: bool = False, level: int = 3, block: int = BLOCK):
        where, inner = open_fs(path)
        where.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out, self.bits, self.block = where.open_output_stream(inner), bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.waiting, self.ids = 0, 0, [], 0
        self.docs, self.known, self.counts, self.index = [], [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], np.array([len(ids)]), ids)

    def extend(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their counts of ids, and all their ids."""
        self.docs += [x or 0 for x in doc_ids]
        self.known += [x is not None for x in doc_ids]
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block * self.block
            for i in range(0, full, self.block):
                self._flush(whole[i : i + self.block])
            self.waiting, self.held = [whole[full:]], len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        offset, planes = self.at, planes_of(ids, self.bits)
        self.index.append([offset, len(ids), *(self._put(self.zip.compress(x)) for x in planes)])

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        docs_at = self.at
        self._put(self.zip.compress(np.array([self.docs, self.known, self.counts], "<i8").tobytes()))
        index_at = self.at
        self._put(self.zip.compress(np.array(self.index, "<i8").tobytes()))
        planes = 32 if self.bits else 4
        self._put(FOOTER.pack(len(self.index), len(self.docs), self.ids, planes, int(self.bits), docs_at, index_at, self.block, MAGIC))
        self.out.close()


class Reader:
    """Reads one file; any block can be read alone through the chunk index."""

    def __init__(self, path: str):
        where, inner = open_fs(path)
        self.file = where.open_input_file(inner)
        size = self.file.size()
        *numbers, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a plane file")
        self.blocks, self.n_docs, self.n_ids, self.planes, bits, docs_at, index_at, self.block = numbers
        self.bits, self.unzip = bool(bits), zstandard.ZstdDecompressor()
        raw = self.unzip.decompress(self.file.read_at(index_at - docs_at, docs_at), max_output_size=24 * self.n_docs)
        self.doc_ids, self.known, self.counts = np.frombuffer(raw, "<i8").reshape(3, self.n_docs)
        raw = self.unzip.decompress(self.file.read_at(size - FOOTER.size - index_at, index_at), max_output_size=8 * self.blocks * (2 + self.planes))
        self.index = np.frombuffer(raw, "<i8").reshape(self.blocks, 2 + self.planes)

    def read_block(self, i: int) -> np.ndarray:
        offset, n, *sizes = self.index[i].tolist()
        raw, at, planes = self.file.read_at(sum(sizes), offset), 0, []
        for size in sizes:
            planes.append(self.unzip.decompress(raw[at : at + size], max_output_size=n))
            at += size
        return ids_of(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids), one block in memory at a time."""
        rest, block, start = np.zeros(0, np.uint32), 0, 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.counts.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.read_block(block))
                have += len(parts[-1])
                block += 1
            whole = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id if known else None, start, whole[:n]
            rest, start = whole[n:], start + n


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, bits: bool = False, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encode texts and write them in doc_id order; returns the manifest (chunk, path, n_docs, n_ids, base).

    Texts are exchanged by ranges of doc_id and cut into chunks in that order;
    each distinct word is encoded once; a chunk is one file, and the order of
    chunks is that of documents. base is the number of ids in all files before.
    The tokenizer must drop white space before it splits.
    """
    spark = docs.sparkSession
    folder = path or new_path(spark, "planes")

    def file_of(chunk: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        if not doc_ids:
            return pa.table({"chunk": pa.array([], pa.int64()), "path": pa.array([], pa.string()), "n_docs": pa.array([], pa.int64()), "n_ids": pa.array([], pa.int64())})
        name = f"{folder}/{chunk:012d}-{uuid.uuid4().hex}.plane"
        writer = Writer(name, bits, block=block)
        writer.extend(doc_ids, np.diff(ends, prepend=0) + 1, np.insert(ids, ends, end_id))
        writer.close()
        return pa.table({"chunk": pa.array([chunk]), "path": [name], "n_docs": pa.array([len(doc_ids)]), "n_ids": pa.array([writer.ids])})

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    made = encoded_chunks(ordered, tokenizer, file_of, "chunk long, path string, n_docs long, n_ids long", chunk_bytes, Blanks)
    files = materialize(made, "manifest")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's files."""

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in Reader(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("path", "base").repartition(partitions(manifest.sparkSession))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
