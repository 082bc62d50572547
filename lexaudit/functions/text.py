"""Column functions on text: blanks, digits, preamble, prose lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as blank, U+001C-1F among them.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"

# Fixed values of the preamble rule.
PROSE_WIDTH = 60
PREAMBLE_LIMIT = 2000
LOWER_SHARE = 0.5
#: Words that open a label line, besides any capitalised words of up to 31 characters before a colon.
LABEL_WORDS = (
    "Autos Processo Processos Protocolo Apelante Apelado Apelada Recorrente Recorrido Recorrida Impetrante Impetrado Impetrada Embargante Embargado Embargada "
    "Agravante Agravado Agravada Requerente Requerido Requerida Interessado Interessada Relator Relatora Sessão Sessao Origem"
).split()
NAMED_LINE = r"[A-ZÀ-Ý][\p{L}\p{N}_.\- ]{0,30}:"
LABEL_LINE = f"^{BLANK}*(?:{NAMED_LINE}|{'|'.join(LABEL_WORDS)})"


def collapse(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(text: Column) -> Column:
    """The digits of a text alone."""
    return F.regexp_replace(text, r"[^0-9]", "")


def is_prose(line: Column) -> Column:
    """A wide line of mixed case that is not a label: running text."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    lower = F.regexp_count(line, F.lit(r"[\p{IsLowercase}&&\p{L}]"))
    label = line.rlike(r"(?U)" + LABEL_LINE + r"\b")
    return (F.length(line) >= PROSE_WIDTH) & ~label & (letters > 0) & (lower >= letters * LOWER_SHARE)


def preamble_end(text: Column) -> Column:
    """Offset of the first prose line; the limit if offsets reach it first; 0 if no line is prose.

    One fold over the lines, in the JVM: state is (offset, answer).
    """
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(state: Column, line: Column) -> Column:
        end = F.when(state["end"].isNotNull(), state["end"]).when(state["at"] >= PREAMBLE_LIMIT, F.lit(PREAMBLE_LIMIT)).when(is_prose(line), state["at"])
        return F.struct((state["at"] + F.length(line) + 1).alias("at"), end.cast("int").alias("end"))

    return F.coalesce(F.aggregate(lines, start, step, lambda s: s["end"]), F.lit(0))


def clamp_window(text: Column, start: Column, before: int, after: int) -> Column:
    """Characters from before ones ahead of offset start (0-based) to after ones behind it."""
    first = F.greatest(start - before, F.lit(0))
    return F.substring(text, first + 1, start + after - first)
