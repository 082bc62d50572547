"""Predictions against gold citations: matches, coverage, paths, classes, calibration, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import overlapping_pairs

LEAST_IOU = 0.5


def match(predicted: DataFrame, gold: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """The predictions (doc_id, idx, start, end, class, record_id, ...) with the first gold citation that overlaps enough.

    gold: doc_id, line, start, end, class, record_id, level; the order is that
    of line. Columns gold_line, gold_class, gold_id and level are null without a match.
    """
    pairs = overlapping_pairs(predicted.select("doc_id", "idx", "start", "end"), gold.select("doc_id", "line", "start", "end", "class", "record_id", "level")).where(F.col("iou") >= least)
    first = pairs.groupBy("doc_id", F.col("a_idx").alias("idx")).agg(F.min(F.struct("b_line", "b_class", "b_record_id", "b_level")).alias("g"))
    slim = first.select("doc_id", "idx", F.col("g.b_line").alias("gold_line"), F.col("g.b_class").alias("gold_class"), F.col("g.b_record_id").alias("gold_id"), F.col("g.b_level").alias("level"))
    return predicted.join(slim, ["doc_id", "idx"], "left")


def right() -> Column:
    """Whether a matched prediction has the gold class and record."""
    return F.col("gold_class").isNotNull() & F.col("class").eqNullSafe(F.col("gold_class")) & F.col("record_id").eqNullSafe(F.col("gold_id"))


def paths(matched: DataFrame) -> DataFrame:
    """(path, n_right, n) of each decision path."""
    return matched.groupBy("path").agg(F.count_if(right()).alias("n_right"), F.count(F.lit(1)).alias("n"))


def missing(predicted: DataFrame, gold: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """Gold citations that no prediction overlaps enough."""
    near = overlapping_pairs(gold.select("doc_id", "line", "start", "end"), predicted.select("doc_id", "idx", "start", "end")).where(F.col("iou") >= least)
    return gold.join(near.select("doc_id", F.col("a_line").alias("line")), ["doc_id", "line"], "left_anti")


def coverage(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n_gold, n_missing, share)."""
    lost = missing(predicted, gold).select("doc_id", "line", F.lit(1).alias("lost"))
    return gold.select("doc_id", "line").join(lost, ["doc_id", "line"], "left").agg(F.count(F.lit(1)).alias("n_gold"), F.coalesce(F.sum("lost"), F.lit(0)).cast("long").alias("n_missing")).withColumn("share", 1 - F.col("n_missing") / F.col("n_gold"))


def class_scores(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """(level, class, tp, n_predicted, n_gold, f1); predictions without a match count at level -1."""
    level = F.coalesce("level", F.lit(-1))
    made = matched.groupBy(level.alias("level"), "class").agg(F.count_if(right()).alias("tp"), F.count(F.lit(1)).alias("n_predicted"))
    true = gold.groupBy("level", "class").agg(F.count(F.lit(1)).alias("n_gold"))
    both = true.join(made, ["level", "class"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    f1 = 2 * zero("tp") / (zero("n_predicted") + zero("n_gold"))
    return both.select("level", "class", zero("tp").alias("tp"), zero("n_predicted").alias("n_predicted"), zero("n_gold").alias("n_gold"), f1.alias("f1"))


def calibration(matched: DataFrame) -> DataFrame:
    """(level, n_declared, brier, real_as_fabricated, fabricated_as_real): the mean runs over declared confidences alone."""
    error = F.pow(F.col("confidence") - F.when(right(), F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2))
    return matched.where("level is not null").groupBy("level").agg(
        F.count("confidence").alias("n_declared"),
        F.avg(error).alias("brier"),
        F.count_if((F.col("gold_class") == "real") & (F.col("class") == "inventada")).alias("real_as_fabricated"),
        F.count_if((F.col("gold_class") == "inventada") & (F.col("class") == "real")).alias("fabricated_as_real"),
    )


def score(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a level: macro F1 plus a bonus of 0.10 * (1 - brier). A metric of our own; the reference one is not public."""
    macro = class_scores(matched, gold).where("level >= 0").groupBy("level").agg(F.avg("f1").alias("macro_f1"))
    found = macro.join(calibration(matched), "level", "left")
    return found.select("level", "macro_f1", "brier", (F.col("macro_f1") + 0.10 * (1 - F.coalesce("brier", F.lit(1.0)))).alias("score"), F.coalesce("real_as_fabricated", F.lit(0)).alias("real_as_fabricated"), F.coalesce("fabricated_as_real", F.lit(0)).alias("fabricated_as_real"))
