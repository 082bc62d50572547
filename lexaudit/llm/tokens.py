"""Words of many texts at once as 64-bit hashes, in numpy.

A word is a longest run of bytes outside of space and 0x09-0x0D, with A-Z
lower-cased. Its hash is a polynomial over random values of its bytes, then
mixed; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds, unless a single text is longer.
PASS_BYTES = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def passes(texts: list[bytes], most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word (one more at the end)."""
    joined = b"\n".join(texts).lower()
    buf = np.frombuffer(joined, np.uint8)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offsets[1:])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    inside = np.flatnonzero(~space[1:-1])
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    terms = _VALUE[buf[inside]] * powers[place]
    return mix(np.add.reduceat(terms, at) ^ lengths.astype(np.uint64)), first


_STEP = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, text by text; a text with fewer words, but not none, has one run.

    Returns the hashes and the index of each text's first one (one more at the end).
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint64)
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            whole += words[k : len(words) - size + 1 + k] * _STEP[k]
        full = counts >= size
        source = np.repeat(first[:-1][full], n[full]) + _ramp(n[full])
        target = np.repeat(at[:-1][full], n[full]) + _ramp(n[full])
        out[target] = whole[source]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        run = words[first[i] : first[i + 1]]
        out[at[i]] = (run * _STEP[: len(run)]).sum(dtype=np.uint64) + np.uint64(len(run))
    return mix(out), at


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... in one array."""
    total = int(n.sum())
    begin = np.repeat(np.cumsum(n) - n, n)
    return np.arange(total) - begin
