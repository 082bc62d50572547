"""Families of appeals, filing formulas, and kinds of citations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, clamp_window, collapse

# Full names in the order they are tried, then acronyms.
NAMES = (
    ("RECLAMA", "reclamacao"),
    ("MANDADO DE SEGURAN", "mandado"),
    ("HABEAS CORPUS", "habeas"),
    ("RECURSO DE REVISTA", "revista"),
    ("AGRAVO DE INSTRUMENTO", "revista"),
    ("RECURSO ESPECIAL", "especial"),
    ("RECURSO EXTRAORDIN", "extraordinario"),
    ("APELA", "apelacao"),
    ("SENTIDO ESTRITO", "sentido_estrito"),
)
ACRONYMS = {
    "AGARR": "revista",
    "AIRR": "revista",
    "ARR": "revista",
    "RR": "revista",
    "ARESP": "especial",
    "AGINT": "especial",
    "EDCL": "especial",
    "RESPE": "eleitoral",
    "RESP": "especial",
    "RCL": "reclamacao",
    "RMS": "mandado",
    "MS": "mandado",
    "RHC": "habeas",
    "HC": "habeas",
    "RE": "extraordinario",
    "APL": "apelacao",
    "RSE": "sentido_estrito",
}
BEFORE, AFTER, FILING_REACH = 80, 10, 240
FILING_FORMULAS = ("vistos relatados", "vistos, relatados", "estes autos de", "autos em que")


def family(text: Column) -> Column:
    """Family of the appeal that a text names, or null."""
    upper = F.upper(text)
    chain = [F.when(F.contains(upper, F.lit(name)), F.lit(value)) for name, value in NAMES]
    chain += [F.when(F.contains(upper, F.lit(a)) & upper.rlike(rf"(?U)(?:\b|-){a}(?:\b|-)"), F.lit(ACRONYMS[a])) for a in sorted(ACRONYMS, key=len, reverse=True)]
    return F.coalesce(*chain)


def family_at(text: Column, start: Column) -> Column:
    """Family named around an occurrence at offset start (0-based)."""
    return family(collapse(clamp_window(text, start, BEFORE, AFTER)))


def files(text: Column, start: Column) -> Column:
    """Whether the filing formula introduces the occurrence at offset start."""
    said = F.lower(collapse(clamp_window(text, start, FILING_REACH, 0)))
    return bind(said, lambda x: reduce(or_, (F.contains(x, F.lit(f)) for f in FILING_FORMULAS)))


def kind(snippet: Column) -> Column:
    """'lei' for a snippet that opens with an article, else 'jurisprudencia'."""
    return F.when(snippet.rlike(r"(?U)\A\s*[Aa]rt(?:igo)?\b"), F.lit("lei")).otherwise(F.lit("jurisprudencia"))
