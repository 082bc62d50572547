"""Exact deduplication against immutable snapshots that binary-fuse filters screen.

A snapshot is published once: its distinct digests lie in exact buckets, and
each bucket has a static filter. Of a later batch, duplicates among its own
rows are grouped separately; each of its distinct digests is screened by the
filter of its bucket, and only those that pass are joined with the exact
bucket. Rows that share a digest are then compared byte for byte.

Defined results: a null text counts as empty, and all empty texts are equal;
a row with a null doc_id is kept apart from none (it groups by its text, and
never stays unless every doc_id of the group is null); repeated rows are rows
of their group; ties on doc_id need no order, since only the id is returned;
a very long text is digested, and compared with texts of its digest, as any
other; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import fuse_filter
from .store import materialize

#: Rows, of the snapshot and the batch together, for which there is a bucket.
BUCKET_DIGESTS = 125_000
#: Digests that may be broadcast (65 bytes each, 13 MB in all); above it both sides are exchanged.
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    """Lowercase hex of SHA-256 over the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("digest"))


def grouped(found: DataFrame) -> DataFrame:
    """(digest, last_id, n) of the rows' distinct digests, combined before the exchange."""
    return found.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def _key(of: pa.ChunkedArray) -> np.ndarray:
    return of.to_numpy().view(np.uint64)


@dataclass(frozen=True)
class Snapshot:
    """Published digests: exact (bucket, digest, key, last_id, n), and filters (bucket, filter)."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def publish(found: DataFrame, buckets: int) -> Snapshot:
    """The snapshot of (doc_id, digest) rows, written to the shared folder.

    A bucket holds distinct digests by their hash, so equal texts, however
    many, weigh as one in it; a bucket is held whole by one task.
    """
    exact = materialize(grouped(found).select(_bucket(buckets), "digest", F.xxhash64("digest", F.lit(1)).alias("key"), "last_id", "n"), "exact")

    def filter_of(part: pa.Table) -> pa.Table:
        return pa.table({"bucket": part["bucket"][:1], "filter": pa.array([fuse_filter.build(_key(part["key"]))], pa.binary())})

    filters = materialize(exact.select("bucket", "key").groupBy("bucket").applyInArrow(filter_of, "bucket int, filter binary"), "filters")
    return Snapshot(exact, filters, buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Those rows of batch (with distinct digests) that pass the filter of their bucket."""
    names = [c for c in batch.columns if c != "bucket"]
    keyed = batch.select(*names, _bucket(snapshot.buckets), F.xxhash64("digest", F.lit(1)).alias("key"))

    def passed(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(filters) or not len(rows):
            return keyed_schema.empty_table()
        return rows.select(names).filter(pa.array(fuse_filter.passes(filters["filter"][0].as_py(), _key(rows["key"]))))

    keyed_schema = to_arrow_schema(batch.select(*names).schema)
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(passed, batch.select(*names).schema)


def deduplicate(docs: DataFrame, is_old: Column, buckets: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): of equal texts the largest doc_id stays.

    Rows where is_old holds are the published snapshot, the others the batch
    that comes in. Weak digests give right results too, only more slowly:
    rows of one digest are grouped by their bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", digest(text).alias("digest"), F.coalesce(is_old, F.lit(False)).alias("old")), "digests")
    if buckets is None:
        buckets = max(1, rows.count() // BUCKET_DIGESTS)
    snapshot = publish(rows.where("old").select("doc_id", "digest"), buckets)
    batch = materialize(grouped(rows.where("not old").select("doc_id", "digest")), "batch")
    seen = screen(batch, snapshot)
    met = seen.join(snapshot.exact.select("digest", F.col("n").alias("n_old")), "digest")
    inner = batch.where("n > 1").select("digest").union(snapshot.exact.where("n > 1").select("digest"))
    shared = materialize(met.select("digest").union(inner).distinct(), "shared")

    with_text = docs.select("doc_id", digest(text).alias("digest"), text.alias("text"))
    candidates = shared.select("digest")
    if shared.count() <= BROADCAST_DIGESTS:
        candidates = F.broadcast(candidates)
    with_text = with_text.join(candidates, "digest", "left_semi")
    by_bytes = materialize(with_text.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    of_digest = by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    one = materialize(of_digest, "digest-groups")
    clashing = one.where("texts > 1").select("digest")

    plain = rows.select("doc_id", "digest").join(one.select("digest", "texts", "keep_id", "group_size"), "digest", "left").where("texts is null or texts = 1")
    out = plain.select("doc_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    if clashing.limit(1).count():
        apart = with_text.join(clashing, "digest", "left_semi").join(by_bytes, ["digest", "text"])
        out = out.union(apart.select("doc_id", "keep_id", F.col("group_size").cast("long"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
