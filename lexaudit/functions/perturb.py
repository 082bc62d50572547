"""Perturbations of texts that keep their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and the letters that scanning puts for them; the share of digits that change.
NOISY_DIGITS, NOISY_LETTERS, NOISE = "01569", "OlSGg", 0.02


def scanning_noise(key: Column, text: Column, share: float = NOISE, seed: int = 0) -> Column:
    """A share of the digits as letters; which ones depends on key, place and seed alone."""
    chars = F.split(text, "")
    limit = int(share * 1_000_000)

    def one(c: Column, i: Column) -> Column:
        hit = F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1_000_000)) < limit
        return F.when(hit, F.translate(c, NOISY_DIGITS, NOISY_LETTERS)).otherwise(c)

    return F.when(text.rlike(f"[{NOISY_DIGITS}]"), F.array_join(F.transform(chars, one), "")).otherwise(text)


def thousands_as_spaces(text: Column) -> Column:
    """Dots between groups of three digits as spaces."""
    return F.regexp_replace(text, r"(?U)(?<=\d)\.(?=\d{3}\b)", " ")


def other_ordinal(text: Column) -> Column:
    """The number mark with a degree sign."""
    return F.replace(F.replace(text, F.lit("nº"), F.lit("n°")), F.lit("Nº"), F.lit("N°"))


def dash_for_hyphen(text: Column) -> Column:
    """A spaced hyphen as a dash."""
    return F.replace(text, F.lit(" - "), F.lit(" – "))


PERTURBATIONS = {
    "original": lambda key, text: text,
    "scanning_noise": scanning_noise,
    "thousands_as_spaces": lambda key, text: thousands_as_spaces(text),
    "other_ordinal": lambda key, text: other_ordinal(text),
    "dash_for_hyphen": lambda key, text: dash_for_hyphen(text),
}
