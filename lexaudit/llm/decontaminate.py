"""Benchmark decontamination by a distributed positional inverted index.

Built of DataFrame operations alone. All tokens of the training texts are
stored as postings (term, text_key, pos), dealt by texts and ordered by term
within each part, so that the index is written without an exchange and a term's
postings lie together. A test window is anchored on its rarest terms, by their
counts over the index; the lists of its anchors are shifted by their offsets in
the window and intersected, with room for a slop. What meets is compared with
the text itself: word for word for exact matches, and for proximity matches
each word within slop places of where it would stand behind the first one.

A term is the 64-bit hash of a word with all letters lower-cased, which only
widens the lists; the comparison lower-cases A-Z alone, as words are defined. A text is known by
128 bits of its hashes, so that equal texts have equal results.

Defined results: null and empty texts have no words, hits or windows; a window
with a term that no training text has is not looked up; rows that share a
doc_id, or have none, are judged each by its own text; repeated rows have equal
results; items that share an item_id are one; a null item_id is left out; an
empty benchmark leaves every document clean; a very long text is compared whole
by one task; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table, and bytes of its strings, that may be broadcast (with 16 bytes a number, 20 MB in all); above them both sides are exchanged.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8_000_000
#: Places that a word may stand off, in a proximity match.
SLOP = 2


def _bounded(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows and bytes allow it."""
    size = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(size, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def coarse_words(text: Column) -> Column:
    """As many words at the same places, all letters lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, phrase, n): runs of size words; an item of fewer, but not none, is one window."""
    split = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(size))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1))
    return split.select("item_id", "w", n.alias("n"), at.alias("at")).select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase"), "n").distinct()


def term_places(phrases: DataFrame) -> DataFrame:
    """(phrase, n, at, term) of every word of each phrase."""
    placed = phrases.select("phrase", "n", F.posexplode(F.split(F.lower("phrase"), " ")).alias("at", "word"))
    return placed.select("phrase", "n", "at", F.xxhash64("word").alias("term"))


def text_key(text: Column) -> Column:
    """64 bits that name a text in postings."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_check(text: Column) -> Column:
    """64 bits more."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1))


def build_index(docs: DataFrame) -> DataFrame:
    """Postings (term, text_key, pos) of all tokens of the texts, in the shared folder."""
    found = docs.select(text_key(F.col("text")).alias("text_key"), F.posexplode(coarse_words(F.col("text"))).alias("pos", "word"))
    return materialize(found.select(F.xxhash64("word").alias("term"), "text_key", "pos").sortWithinPartitions("term"), "postings")


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_training) of the wanted terms over all postings."""
    return postings.select("term").join(_bounded(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_training"))


def anchors(phrases: DataFrame, counts: DataFrame, per_phrase: int = 2) -> DataFrame:
    """(term, phrase, n, at, bit, wanted): each phrase's rarest terms; phrases with an unknown term are left out."""
    placed = term_places(phrases).join(counts, "term", "left")
    by = Window.partitionBy("phrase")
    ranked = placed.withColumn("known", F.count("n_training").over(by)).where("known = n").withColumn("rank", F.row_number().over(by.orderBy("n_training", "at"))).where(F.col("rank") <= per_phrase)
    every = F.expr(f"shiftleft(1L, least(n, {per_phrase})) - 1")
    return ranked.select("term", "phrase", "n", "at", F.expr("shiftleft(1L, rank - 1)").alias("bit"), every.alias("wanted"))


def candidates(postings: DataFrame, anchored: DataFrame, slop: int = SLOP) -> DataFrame:
    """(text_key, phrase_key, low): places from low on, for 2 * (2 * slop + 1) + slop, where all anchors of a phrase meet within the slop."""
    wide = 2 * slop + 1
    lists = postings.join(_bounded(anchored.select("term", F.xxhash64("phrase").alias("phrase_key"), "at", "bit", "wanted")), "term")
    start = F.floor((F.col("pos") - F.col("at")) / wide)
    cells = lists.select("text_key", "phrase_key", "bit", "wanted", F.explode(F.array(start, start + 1)).alias("cell"))
    met = cells.groupBy("text_key", "phrase_key", "cell").agg(F.bit_or("bit").alias("bits"), F.max("wanted").alias("wanted")).where("bits = wanted")
    return met.select("text_key", "phrase_key", ((F.col("cell") - 1) * wide - slop).cast("int").alias("low"))


def _near(w: Column, phrase: Column, at: Column, slop: int) -> Column:
    """Whether each word of phrase stands in w within slop places of its own behind place at (from 0)."""

    def close(word: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), at + i - F.when(i == 0, F.lit(0)).otherwise(F.lit(slop)))
        last = at + i + F.when(i == 0, F.lit(0)).otherwise(F.lit(slop))
        return F.array_contains(F.slice(w, first + 1, F.greatest(F.lit(0), last - first + 1)), word)

    return F.forall(F.transform(phrase, lambda word, i: close(word, i)), lambda x: x)


def phrase_matches(docs: DataFrame, phrases: DataFrame, slop: int = SLOP, index: DataFrame | None = None) -> DataFrame:
    """(text_key, check, start, n, phrase, exact) of the occurrences of the phrases (phrase, n), start from 0; exact or within the slop.

    index is a stored one of the same texts; without it one is built.
    """
    phrases = materialize(phrases.select("phrase", "n").distinct(), "phrases")
    postings = build_index(docs) if index is None else index
    terms = materialize(term_places(phrases).select("term").distinct(), "terms")
    anchored = materialize(anchors(phrases, materialize(term_counts(postings, terms), "term-counts")), "anchors")
    places = materialize(candidates(postings, anchored, slop), "places")
    known = _bounded(materialize(phrases.select(F.xxhash64("phrase").alias("phrase_key"), "phrase", "n"), "phrase-keys"))
    listed = places.join(known, "phrase_key").groupBy("text_key").agg(F.collect_set(F.struct("phrase", "n", "low")).alias("places"))
    keys = _bounded(materialize(places.select("text_key").distinct(), "place-keys"))
    texts = docs.select(text_key(F.col("text")).alias("text_key"), text_check(F.col("text")).alias("check"), "text").join(keys, "text_key", "left_semi")
    texts = texts.dropDuplicates(["text_key", "check"]).select("text_key", "check", words(F.col("text")).alias("w"))

    def matches(place: Column) -> Column:
        parts = F.split(place["phrase"], " ")
        first = F.greatest(F.lit(0), place["low"])
        last = F.least(F.size("w") - 1, place["low"] + 2 * (2 * slop + 1) + 2 * slop)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        opened = F.filter(starts, lambda s: F.get("w", s) == F.get(parts, F.lit(0)))
        judged = F.transform(opened, lambda s: F.struct(s.alias("start"), place["n"].alias("n"), place["phrase"].alias("phrase"), (F.slice("w", s + 1, place["n"]) == parts).alias("exact"), _near(F.col("w"), parts, s, slop).alias("near")))
        return F.filter(judged, lambda x: x["near"])

    found = texts.join(listed, "text_key").select("text_key", "check", F.explode(F.flatten(F.transform("places", matches))).alias("m"))
    return found.select("text_key", "check", "m.start", "m.n", "m.phrase", "m.exact").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = SLOP) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of docs; n_near counts inexact proximity matches of windows."""
    of_items = materialize(windows(items, size), "windows")
    found = materialize(phrase_matches(docs, of_items, slop), "matches")
    hits, key = found.where("exact"), ["text_key", "check"]
    by = Window.partitionBy(*key).orderBy("start", "n")
    end = F.col("start") + F.col("n")
    reach = F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.select(*key, "start", "n").distinct().select(*key, F.greatest(F.lit(0), end - F.greatest(F.col("start"), reach)).alias("fresh"))
    covered = spans.groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*key, "phrase").join(_bounded(of_items.select("phrase", F.col("item_id").cast("string").alias("item"))), "phrase").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = found.where("not exact").groupBy(*key).agg(F.count(F.lit(1)).alias("n_near"))
    told = materialize(covered.join(named, key).join(near, key, "full"), "told")
    counted = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), text_check(F.col("text")).alias("check"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).cast("long").alias("n_words"))
    found = counted.join(told, key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    out = ["doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")]
    return found.select(*out, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
