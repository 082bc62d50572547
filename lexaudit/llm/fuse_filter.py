"""Static 3-wise binary-fuse filters over 64-bit keys, in numpy (Graf and Lemire, 2022)."""

from __future__ import annotations

import math

import numpy as np

from .tokens import mix

_U = np.uint64


def _cells(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells of each key (rows) and its fingerprint."""
    h = mix(keys + _U(seed))
    low = ((h >> _U(32)) * _U(count * segment)) >> _U(32)
    mask = _U(segment - 1)
    a = low
    b = (low + _U(segment)) ^ ((h >> _U(18)) & mask)
    c = (low + _U(2 * segment)) ^ (h & mask)
    print_ = mix(h ^ _U(0xA5A5A5A5A5A5A5A5)).astype(np.uint16)
    return np.stack([a, b, c]).astype(np.int64), print_


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys: 24 bytes of header, then 16-bit cells (about 2.3 bytes a key).

    Every key passes it; another passes with probability 2**-16. Keys are
    peeled in rounds, each round whole in numpy, and cells are filled in the
    reverse order of rounds. No keys make a filter that nothing passes.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return b""
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    size = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) if n > 1 else 0
    for seed in range(1, 200):
        count = max(1, (size + segment - 1) // segment - 2) + (seed > 20)
        cells, prints = _cells(keys, seed, segment, count)
        rounds = _peel(cells, (count + 2) * segment)
        if rounds is None:
            continue
        table = np.zeros((count + 2) * segment, np.uint16)
        for index, place in reversed(rounds):
            three = cells[:, index]
            value = prints[index] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            table[place] ^= value
        return np.array([seed, segment, count], np.int64).tobytes() + table.tobytes()
    raise ValueError("no seed peels these keys")


def _peel(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell that is each one's alone), or None if some keys stay."""
    n = cells.shape[1]
    flat, index = cells.ravel(), np.tile(np.arange(n), 3)
    held = np.bincount(flat, minlength=size)
    total = np.zeros(size, np.int64)
    np.add.at(total, flat, index)
    alone, rounds, left = np.flatnonzero(held == 1), [], n
    while len(alone):
        found, at = np.unique(total[alone], return_index=True)
        rounds.append((found, alone[at]))
        left -= len(found)
        touched = cells[:, found].ravel()
        np.subtract.at(held, touched, 1)
        np.subtract.at(total, touched, np.tile(found, 3))
        alone = np.unique(touched)
        alone = alone[held[alone] == 1]
    return None if left else rounds


def passes(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets pass."""
    if not filter_:
        return np.zeros(len(keys), bool)
    seed, segment, count = np.frombuffer(filter_[:24], np.int64).tolist()
    table = np.frombuffer(filter_[24:], np.uint16)
    three, prints = _cells(keys.astype(np.uint64), seed, segment, count)
    return (table[three[0]] ^ table[three[1]] ^ table[three[2]]) == prints
