"""Memory of the first step of PPM, which holds a whole chunk, and its counts."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lexaudit.llm import ppm


def test_a_chunk_is_counted_in_little_memory(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts, "held_out": [i % 7 == 0 for i in range(1000)]})
    docs = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    docs.select = lambda *columns: docs
    monkeypatch.setattr(ppm, "materialize", lambda made, name: made)
    monkeypatch.setattr(ppm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = ppm.gather(docs, 12)
    tracemalloc.start()
    made = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 1 and made[0].num_rows == 25
    assert peak < 20 * sum(map(len, texts))


def test_counts_of_passes():
    rng = np.random.Generator(np.random.PCG64(3))
    counts, want = ppm.Counts(), {}
    for size, train in ((0, True), (50, True), (400, True), (3, False), (400, False), (1, True), (90, True)):
        keys = rng.integers(0, 2**64 if size == 90 else 300, size, np.uint64)
        counts.add(keys, train)
        for x in keys.tolist():
            want[x] = want.get(x, 0) + train
    keys, n = counts.sum()
    assert keys.tolist() == sorted(want) and n.tolist() == [want[x] for x in sorted(want)] and n.dtype == np.int64
    assert [x.tolist() for x in ppm.Counts().sum()] == [[], []]
