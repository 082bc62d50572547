"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words and word shapes fall into a fixed number of rows by their hashes. Each
row has a sparse random index vector; its context vector is the sum of the
index vectors of the words and shapes around it, over the texts of the fit
sample. A document is the mean of its words' unit context vectors, the mean
of its shapes', and three figures (length, share of distinct words, bytes a
word). A network with one hidden layer maps that to a logit; a temperature
found on rows that training has not seen makes it a probability.

The fit sample is bounded: FIT_ROWS labelled rows with the least hashes of
their doc_id. Every document is scored over its whole text.

Defined results: an empty or null text is scored as a document without words;
a row without doc_id counts as held out and is scored as any other; labels
without quality, without a document, or in conflict (the larger label counts)
do no harm; documents that tie in the hash of their doc_id are taken by
doc_id; rows of one labelled doc_id are all in the sample, at most those with
the FIT_ROWS least ids; with labels of one kind or none, that share is the
score of all; repeated rows are scored alike; a very long text is pooled whole
by one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, materialize, returned
from .tokens import mix, passes, texts_of, word_hashes

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Parts that the fit sample is dealt to; each sends one sum of contexts (8 MB).
FIT_PARTS = 16
#: Bytes of text whose contexts are summed at once (some 60 bytes of arrays a byte).
CONTEXT_BYTES = 250_000
ROWS, DIMS, REACH, BLOCKS = 1 << 14, 64, 2, 16

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def index_vectors() -> np.ndarray:
    """Four random signs in each row of ROWS x DIMS."""
    rng = np.random.Generator(np.random.PCG64(31))
    out = np.zeros((ROWS, DIMS), np.float32)
    for _ in range(4):
        out[np.arange(ROWS), rng.integers(0, DIMS, ROWS)] += rng.choice(np.array([-1, 1], np.float32), ROWS)
    return out


def shapes(texts: list[bytes]) -> np.ndarray:
    """A number for the look of each word: capitals, digits, mark at its end, length."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SEP[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)

    def sums(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts]

    capital, digit = sums((buf >= 65) & (buf <= 90)), sums((buf >= 48) & (buf <= 57))
    last = buf[ends - 1]
    letter = ((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128)
    mark = np.where(letter, 0, last)
    twice = (ends - starts > 1) & ~letter & (buf[np.maximum(ends - 2, 0)] == last)
    length = np.minimum(np.log2(ends - starts + 1).astype(np.int64), 5)
    return ((np.minimum(capital, 2) * 2 + (digit > 0)) * 2 + twice) * 8 * 256 + length * 256 + mark


def rows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, row of each word's shape, word hashes, index of each text's first word."""
    hashes, first = word_hashes(texts)
    of_shape = mix(shapes(texts).astype(np.uint64) + np.uint64(1 << 40))
    half = np.uint64(ROWS // 2)
    return (hashes % half).astype(np.int64) + ROWS // 2, (of_shape % half).astype(np.int64), hashes, first


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit context vectors (ROWS x DIMS, 4 MB) over the texts; partitions send sums, merged by block of rows."""
    bounded_batches(texts.sparkSession)
    step = ROWS // BLOCKS

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((ROWS, DIMS), np.float64)
        for batch in batches:
            held = texts_of(batch.column("text"))
            for a, b in passes(held, CONTEXT_BYTES):
                words, looks, _, first = rows_of(held[a:b])
                if not len(words):
                    continue
                own = np.repeat(np.arange(b - a), np.diff(first))
                near = np.zeros((len(words), DIMS), np.float32)
                around = index[words] + index[looks]
                for d in range(1, REACH + 1):
                    same = (own[d:] == own[:-d])[:, None]
                    near[d:] += around[:-d] * same
                    near[:-d] += around[d:] * same
                for rows in (words, looks):
                    order = np.argsort(rows, kind="stable")
                    found, at = np.unique(rows[order], return_index=True)
                    total[found] += np.add.reduceat(near[order], at, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(BLOCKS)])], ["block", "sums"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(step * DIMS)
        for x in parts["sums"]:
            out += np.frombuffer(x, np.float64)
        return pd.DataFrame({"block": parts["block"].iloc[:1], "sums": [out.tobytes()]})

    parts = texts.select("text").mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(merge, "block int, sums binary").collect()
    total = np.zeros((ROWS, DIMS))
    for block, sums in parts:
        total[block * step : (block + 1) * step] = np.frombuffer(sums, np.float64).reshape(step, DIMS)
    total += index_vectors() * 0.5
    return (total / np.linalg.norm(total, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of 2 * DIMS + 3 figures for each text."""
    out = np.zeros((len(texts), 2 * DIMS + 3), np.float32)
    for a, b in passes(texts, 2 * CONTEXT_BYTES):
        words, looks, hashes, first = rows_of(texts[a:b])
        n = np.diff(first)
        for i in np.flatnonzero(n):
            own = slice(first[i], first[i + 1])
            at, times = np.unique(words[own], return_counts=True)
            out[a + i, :DIMS] = times @ vectors[at] / n[i]
            seen, times = np.unique(looks[own], return_counts=True)
            out[a + i, DIMS : 2 * DIMS] = times @ vectors[seen] / n[i]
            out[a + i, 2 * DIMS :] = np.log1p(n[i]) / 10, len(np.unique(hashes[own])) / n[i], np.log1p(len(texts[a + i]) / n[i]) / 3
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised inputs; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the temperature is that of least loss on the rest."""
    rng = np.random.Generator(np.random.PCG64(9))
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(x))
    apart, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(0) if len(own) else np.zeros(x.shape[1]), (x[own].std(0) if len(own) else np.ones(x.shape[1])).clip(1e-3)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.array(np.log(share / (1 - share)))]
    if len(np.unique(y)) > 1:
        params[2] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        z = (x - mean) / scale
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
                a = np.tanh(z[part] @ params[0] + params[1])
                g = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -60, 60))) - y[part]) / len(part)
                back = np.outer(g, params[2]) * (1 - a * a)
                grads, t = [z[part].T @ back + decay * params[0], back.sum(0), a.T @ g + decay * params[2], g.sum()], t + 1
                for i, grad in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
                    params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3]), 1.0)
    if len(apart):
        z = net.logits(x[apart])
        best = min(np.geomspace(0.25, 8, 41), key=lambda t: _loss(z / t, y[apart]))
        net = Network(mean, scale, params[0], params[1], params[2], float(params[3]), float(best))
    return net


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from the model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most rows labelled documents that are not held out."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(materialize(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "chosen"))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    sample = materialize(sample.repartition(FIT_PARTS, F.xxhash64("doc_id")), "sample")
    vectors = word_vectors(sample)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pooled(texts_of(batch.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([x.tobytes() for x in made], pa.binary())], ["doc_id", "quality", "x"])

    made = sample.mapInArrow(run, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(r, np.float32) for r in made["x"]]) if len(made) else np.zeros((0, 2 * DIMS + 3), np.float32)
    return vectors, train(x, made["quality"].to_numpy() > 0)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    bounded_batches(docs.sparkSession)
    vectors, net = model

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probability(pooled(texts_of(batch.column("text")), vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
