"""Audits without labels, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that never open a citation.
WRONG_OPENINGS = [
    "O", "A", "Os", "As", "Conforme", "Segundo", "Vide", "Todavia", "Contudo", "Entretanto", "Assim", "Ainda", "Também", "Ademais",
    "Outrossim", "Portanto", "DJ", "DJe", "DJE", "DEJT", "DOU", "DOE", "Evento", "ID", "Seq", "fls", "fls.", "doc", "doc.", "Anexo", "Mov",
]


def first_word(spans: DataFrame) -> DataFrame:
    """The spans with the word that opens them."""
    return spans.withColumn("opening", F.coalesce(F.get(F.filter(F.split("snippet", r"(?U)\s+"), lambda w: w != ""), F.lit(0)), F.lit("")))


def opening_counts(spans: DataFrame, top: int | None = None) -> DataFrame:
    """(opening, n, wrong), most frequent first, of equal ones by the word; top is the report's length."""
    counted = first_word(spans).groupBy("opening").agg(F.count(F.lit(1)).alias("n")).withColumn("wrong", F.col("opening").isin(WRONG_OPENINGS))
    return counted.orderBy(F.desc("n"), "opening").limit(top) if top else counted


def court_counts(spans: DataFrame) -> DataFrame:
    """(court, n); records without a court count together."""
    return spans.groupBy(F.coalesce("court", F.lit("sem registro")).alias("court")).agg(F.count(F.lit(1)).alias("n"))


def wrong_examples(spans: DataFrame, keep: int = 3) -> DataFrame:
    """(opening, examples): the first snippets of each wrong opening, by document and place."""
    wrong = first_word(spans).where(F.col("opening").isin(WRONG_OPENINGS))
    rank = F.row_number().over(Window.partitionBy("opening").orderBy("doc_id", "start"))
    kept = wrong.withColumn("r", rank).where(F.col("r") <= keep)
    return kept.groupBy("opening").agg(F.array_sort(F.collect_list(F.struct("r", F.substring("snippet", 1, 64).alias("s")))).alias("e")).select("opening", F.col("e.s").alias("examples"))


def wrong_share(spans: DataFrame) -> DataFrame:
    """One row (n, n_wrong, percent)."""
    found = first_word(spans).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("opening").isin(WRONG_OPENINGS)).alias("n_wrong"))
    return found.withColumn("percent", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(100 * F.col("n_wrong") / F.col("n")))


def sample(docs: DataFrame, n: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """n rows, chosen by a hash of their key: the same ones in every run."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def folds(scores: DataFrame, parts: int, reference: float, slack: float = 0.01) -> DataFrame:
    """One row (worst, median, best, n_parts, n_below) of per-document scores (doc_id, score) cut into parts by order of doc_id; the median is the upper one."""
    n = scores.count()
    size = max(1, n // parts)
    place = F.row_number().over(Window.orderBy("doc_id")) - 1
    each = scores.select("score", F.floor(place / size).alias("part")).groupBy("part").agg(F.avg("score").alias("score"))
    upper = F.row_number().over(Window.orderBy("score", "part")) - 1
    ranked = each.withColumn("r", upper).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.agg(F.min("score").alias("worst"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("score"))).alias("median"), F.max("score").alias("best"), F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("score") < reference - slack).alias("n_below"))


def ablation(runs: DataFrame, limit: float = 0.02) -> DataFrame:
    """(rule, drop_a, drop_b, asymmetry, flagged) of runs (base, rule, score), where rule '' is the full set."""
    full = runs.where("rule = ''").select("base", F.col("score").alias("whole"))
    drops = runs.where("rule <> ''").join(full, "base").select("rule", "base", (F.col("whole") - F.col("score")).alias("drop"))
    wide = drops.groupBy("rule").pivot("base", ["a", "b"]).agg(F.first("drop")).select("rule", F.col("a").alias("drop_a"), F.col("b").alias("drop_b"))
    gap = F.abs(F.col("drop_a") - F.col("drop_b"))
    return wide.withColumn("asymmetry", gap).withColumn("flagged", gap > limit)


def ablate(run: Callable[[frozenset[str]], DataFrame], rules: frozenset[str]) -> DataFrame:
    """(rule, ...) rows of run for all rules, as rule '', and without each one."""
    out = run(rules).select(F.lit("").alias("rule"), "*")
    for rule in sorted(rules):
        out = out.unionByName(run(rules - {rule}).select(F.lit(rule).alias("rule"), "*"))
    return out


def changed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Documents of before whose listed columns differ in after, or that after lacks; documents only in after are not looked at."""
    values = F.struct(*columns)
    a = before.select("doc_id", values.alias("before"))
    b = after.select("doc_id", values.alias("after"))
    return a.join(b, "doc_id", "left").where(~F.col("before").eqNullSafe(F.col("after")))


def changed_prompts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, idx, before, after): questions (doc_id, idx, system, question) that only one of two runs asks, or that they word differently."""
    said = F.concat_ws("\n", "system", "question")
    a, b = before.select("doc_id", "idx", said.alias("before")), after.select("doc_id", "idx", said.alias("after"))
    return a.join(b, ["doc_id", "idx"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def listed(rows: DataFrame, docs: DataFrame, columns: list[str], order: str = "idx") -> DataFrame:
    """(doc_id, predictions): the listed columns of all rows of each document of docs, in their order; empty for documents without rows."""
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("all"))
    plain = F.transform("all", lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return docs.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce(plain, F.array()).alias("predictions"))
