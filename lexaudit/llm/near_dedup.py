"""Near-duplicate documents by MinHash with tensored banding.

A table key is made of two halves. Two collections of m short signatures are
computed, of k minhashes each; the m * m tables take one signature of the
left collection and one of the right, so that 2 * m * k minhashes serve
m * m tables of 2 * k rows each. A pair of similarity s shares a key with
probability (1 - (1 - s**k)**m)**2: 0.9996 at s = 0.85 with m = 9, k = 3. Keys
are formed only of halves that two sets share, as no other key has a partner.

Texts with equal shingle sets form one class, which the 64-bit sum of its
shingle hashes names. Of each key, the class that shares most keys is the
head; every other class is compared with it on full sets, and so, among the
classes that are not linked with it yet, with a second head. Pairs of a key
that these stars leave in different components are found by an exact filter
on differences from the head C: with X = A xor C and Y = B xor C, A xor B is
X xor Y, so a link of A and B asks for an overlap of X and Y of at least
(|X| + |Y| - e * (|A| + |B|)) / 2 where e = (1 - t) / (1 + t). As A and B are
not both linked with C, that is above 0. Differences are ordered by how many
classes have them, only prefixes that must meet are joined, and what
meets is compared on full sets. Copies of one text with changes of their own
differ from it in places of their own, so that pairs follow shared changes and
not the size of a group.

Defined results: words are longest runs outside of space and 0x09-0x0D with
A-Z lower-cased; a text with fewer words than a shingle, but not none, has its
whole sequence as one shingle; an empty or null text has none and is linked
with nothing; repeated rows are equal sets; rows that share a doc_id but not
their text are documents of their own, each in the component of its text; a
very long text is one set, held whole by one task; an empty table gives no
rows; a null doc_id is linked with nothing; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import bounded_batches, discard, materialize, partitions, returned
from .tokens import mix, passes, shingle_hashes, texts_of, word_hashes

#: Ids that may be broadcast (16 bytes each, 8 MB in all); above it both sides are exchanged.
BROADCAST_IDS = 500_000
#: Classes that are compared with one copy of their head's set.
STAR = 256
#: Elements of differences that one batch returns, at least one class's.
FLAT = 200_000

_RANDOM = np.random.Generator(np.random.PCG64(4242)).integers(0, 2**63, (2, 4096), np.uint64)


def signatures(docs: DataFrame, size: int = 5, m: int = 9, k: int = 3) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, halves): set size, 128 bits that name the set, 2 * m half keys."""
    bounded_batches(docs.sparkSession)
    factor = _RANDOM[0, : 2 * m * k] * np.uint64(2) + np.uint64(1)
    shift = _RANDOM[1, : 2 * m * k] * np.uint64(3)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            parts = [_signed(texts[a:b], size, m, k, factor, shift) for a, b in passes(texts)]
            if not parts:
                continue
            n, one, two, halves = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = pa.ListArray.from_arrays(np.arange(0, 2 * m * (len(n) + 1), 2 * m, dtype=np.int32), halves.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def _signed(texts: list[bytes], size: int, m: int, k: int, factor: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    hashes, at = shingle_hashes(*word_hashes(texts), size)
    n, one, two = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
    halves = np.zeros((len(texts), 2 * m), np.uint64)
    full = np.flatnonzero(np.diff(at))
    for i in full:
        own = np.unique(hashes[at[i] : at[i + 1]])
        n[i], one[i], two[i] = len(own), own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    if len(full):
        for half in range(2 * m):
            joint = np.zeros(len(full), np.uint64)
            for j in range(half * k, half * k + k):
                joint = mix(joint ^ np.minimum.reduceat(hashes * factor[j] + shift[j], at[:-1][full]))
            halves[full, half] = joint
    return n, one, two, halves


def table_keys(classes: DataFrame, m: int = 9) -> DataFrame:
    """(key, node): the keys of each class (node, halves), each of a left and a right half that another class has too."""
    flat = classes.select("node", F.posexplode("halves").alias("i", "half"))
    shared = flat.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("half")
    held = flat.join(shared, "half").groupBy("node")
    sides = held.agg(*(F.collect_list(F.when((F.col("i") < m) == left, F.col("half"))).alias(name) for name, left in (("lefts", True), ("rights", False))))
    pairs = F.flatten(F.transform("lefts", lambda x: F.transform("rights", lambda y: F.xxhash64(x, y))))
    return sides.select("node", F.explode(pairs).alias("key")).select("key", "node")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(node, shingles): sorted 64-bit hashes of each text's distinct shingles, as bytes, and their sum."""
    bounded_batches(docs.sparkSession)

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in passes(texts):
                hashes, at = shingle_hashes(*word_hashes(texts[a:b]), size)
                own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)]
                names = np.array([x.sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame, each: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What each makes of (head, node, part, head's set, node's set) of the pairs (head, node, part), task by task.

    A head's set is sent once for STAR of its classes and held while they pass by.
    """
    bounded_batches(pairs.sparkSession)
    dealt = pairs.join(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")), "head")
    dealt = dealt.select("head", "node", "part", F.pmod(F.xxhash64("node"), F.col("parts")).alias("salt"))
    body = dealt.join(sets, "node").select("head", "salt", F.lit(1).alias("kind"), "node", "part", "shingles")
    tops = dealt.select("head", "salt").distinct().join(sets.withColumnRenamed("node", "head"), "head")
    tops = tops.select("head", "salt", F.lit(0).alias("kind"), F.col("head").alias("node"), F.lit(None).cast("long").alias("part"), "shingles")
    ordered = body.union(tops).repartition(partitions(pairs.sparkSession), "head", "salt").sortWithinPartitions("head", "salt", "kind")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        top = np.zeros(0, np.uint64)
        for batch in batches:
            for head, kind, node, part, data in zip(*(batch.column(c) for c in ("head", "kind", "node", "part", "shingles")), strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if kind.as_py():
                    yield head.as_py(), node.as_py(), part.as_py(), top, own
                else:
                    top = own.copy()

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(rows(batches))

    return ordered.mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b): the pairs (head, node) whose sets have 100 * intersection >= percent * union."""

    def linked(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for head, node, _, one, two in rows:
            both = len(np.intersect1d(one, two, assume_unique=True)) if min(len(one), len(two)) * 100 >= percent * max(len(one), len(two)) else 0
            if both and 100 * both >= percent * (len(one) + len(two) - both):
                a.append(head)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _compared(pairs.select("head", "node", F.lit(None).cast("long").alias("part")), sets, linked, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(head, node, part, n, d, shingle): of each pair the d shingles that one of the two sets has; n is the node's set size."""

    def flat(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            lengths = [len(x[-1]) for x in held]
            columns = [np.repeat(np.array([x[i] for x in held], np.int64), lengths) for i in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.concatenate([x[-1] for x in held]).view(np.int64))], ["head", "node", "part", "n", "d", "shingle"])

        for head, node, part, one, two in rows:
            apart = np.setxor1d(one, two, assume_unique=True)
            held.append((head, node, part, len(two), len(apart), apart))
            size += len(apart)
            if size >= FLAT:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return _compared(pairs.select("head", "node", "part"), sets, flat, "head long, node long, part long, n long, d long, shingle long")


def close_pairs(apart: DataFrame, percent: int = 85) -> DataFrame:
    """(head, node) of classes of different parts that differences (as made above) let be linked: all that are, and few others.

    Shingles that no other part differs in come first, then those that few
    classes differ in; of a class with n shingles only places up to
    n * (1 - t) / t can be the first that it shares with a linked class.
    """
    shared = apart.groupBy("head", "shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("holders"))
    useful = apart.join(shared.where("low < high").select("head", "shingle", "holders"), ["head", "shingle"])
    by = "row_number() over (partition by head, node order by holders, shingle) - count(*) over (partition by head, node)"
    placed = useful.select("*", (F.col("d") - 1 + F.expr(by)).alias("place"))
    first = materialize(placed.where(F.col("place") * percent <= F.col("n") * (100 - percent)).select("head", "shingle", "node", "part", "n", "d", "place"), "prefixes")
    other = first.select("head", "shingle", *(F.col(c).alias(f"b_{c}") for c in ("node", "part", "n", "d", "place")))
    overlap = F.least(F.col("d") - F.col("place"), F.col("b_d") - F.col("b_place"))
    asked = (100 + percent) * (F.col("d") + F.col("b_d")) - (100 - percent) * (F.col("n") + F.col("b_n"))
    sizes = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
    fits = (F.col("node") < F.col("b_node")) & (F.col("part") != F.col("b_part")) & sizes & (2 * (100 + percent) * overlap >= asked)
    return first.join(other, ["head", "shingle"]).where(fits).select(F.col("node").alias("head"), F.col("b_node").alias("node")).distinct()


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with part, their component; only of keys that several components share."""
    placed = members.drop("part").join(labels.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return placed.join(mixed, "key")


def components(members: DataFrame, sets: DataFrame, percent: int = 85) -> DataFrame:
    """(node, label) of all classes with a link, from the members (key, node) of keys that several classes share."""
    weights = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("node").agg(F.sum("n").alias("weight"))
    weighted = materialize(members.join(weights, "node").select("key", "node", "weight"), "weighted")
    top = F.max(F.struct("weight", "node")).alias("top")
    pivots = materialize(weighted.groupBy("key").agg(top).select("key", F.col("top.node").alias("pivot")), "pivots")
    rest = weighted.join(pivots, "key").where("node <> pivot")
    links = materialize(verified(rest.select(F.col("pivot").alias("head"), "node").distinct(), sets, percent), "links")
    labels = connected_components(links)

    def more(pairs: DataFrame) -> None:
        nonlocal links, labels
        new = materialize(verified(pairs, sets, percent), "links")
        if new.limit(1).count():
            links = links.union(new)
            labels = connected_components(links)

    open_ = materialize(_placed(rest, labels), "open")
    if open_.limit(1).count():
        of_pivot = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_part"))
        apart = open_.join(of_pivot, "pivot", "left").where(F.col("part") != F.coalesce("pivot_part", "pivot"))
        second = apart.groupBy("key").agg(F.max(F.struct("weight", "node", "part")).alias("top")).select("key", F.col("top.node").alias("head"), F.col("top.part").alias("head_part"))
        more(open_.join(second, "key").where("part <> head_part").select("head", "node").distinct())
        open_ = materialize(_placed(open_.join(second, "key", "left").where("head is null or node <> head").drop("head", "head_part"), labels), "open")
        if open_.limit(1).count():
            flat = materialize(differences(open_.select(F.col("pivot").alias("head"), "node", "part").distinct(), sets), "differences")
            more(materialize(close_pairs(flat, percent), "pairs"))
            discard(flat)
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, m: int = 9, k: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept where doc_id is the component's least."""
    signed = materialize(signatures(docs, size, m, k), "signatures")
    least = F.min(F.struct("doc_id", "halves")).alias("least")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(least)
    classes = materialize(classes.select(F.col("set_a").alias("node"), F.col("least.doc_id").alias("class_id"), "least.halves"), "classes")
    keys = materialize(table_keys(classes, m), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = materialize(keys.join(shared, "key"), "members")
    discard(keys)

    ids = materialize(members.select("node").distinct().join(classes.select("node", "class_id"), "node").select(F.col("class_id").alias("doc_id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), size).dropDuplicates(["node"]), "sets")
    labels = components(members, sets, percent)
    discard(sets)
    discard(members)

    grouped = classes.select("node", "class_id").join(labels, "node")
    named = grouped.select("node", "label").join(grouped.groupBy("label").agg(F.min("class_id").alias("component_id")), "label")
    of_class = classes.select("node", "class_id").join(named.select("node", "component_id"), "node", "left").select(F.col("node").alias("set_a"), F.coalesce("component_id", "class_id").alias("component_id"))
    lone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    out = signed.select("doc_id", "n_shingles", "set_a").join(of_class, "set_a", "left")
    out = out.select("doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
