"""Case identifiers in a snippet: blocks of digits with scanning noise, normalised.

Expressions of built-in functions alone, so that they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, digits

# Letters that scanning puts for digits, and the digits they stand for.
OCR_LETTERS = "OolIGgSs"
OCR_DIGITS = "00116955"

BLOCK = rf"[0-9{OCR_LETTERS}](?:[0-9{OCR_LETTERS}.\-\x20\n\r\t\xa0]*[0-9{OCR_LETTERS}])?"
#: Letters that tokens of identifiers may have besides digits, in lower case (see BLOCK).
TOKEN_LETTERS = "".join(sorted(set(OCR_LETTERS.lower())))
_EDGE = ".- \n\r\t\u00a0"
_MARK = "\u0003"
#: A letter that a digit stands behind, or before, with nothing but dots between.
_BEFORE_DIGIT = rf"[{OCR_LETTERS}](?=\.*[0-9])"
_BEHIND_DIGIT = rf"([0-9]\.*)([{OCR_LETTERS}])"


def group_thousands(number: Column) -> Column:
    """Dots between groups of three digits, from the right."""
    return F.regexp_replace(number, r"(?<=\d)(?=(?:\d{3})+$)", ".")


def mask_unified(number: Column) -> Column:
    """Twenty digits in the mask 7-2.4.1.2.4 of unified case numbers."""
    return F.regexp_replace(number, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", "$1-$2.$3.$4.$5.$6")


def _trimmed_and_translated(block: Column) -> Column:
    """Lone letters cut off both ends, then letters beside digits as digits; neighbours are those of the given block.

    Letters to translate are marked first, so that no rewrite changes what
    another letter stands beside; the first character behind a mark is then
    translated. Trimming cuts unmarked letters only.
    """
    marked = F.regexp_replace(F.regexp_replace(block, _BEFORE_DIGIT, _MARK + "$0"), _BEHIND_DIGIT, "$1" + _MARK + "$2")
    marked = F.regexp_replace(marked, rf"^[{OCR_LETTERS}]+", "")
    marked = _cut_tail(marked)
    marked = F.btrim(marked, F.lit(_EDGE))
    return bind(F.split(marked, _MARK, -1), lambda pieces: F.array_join(F.transform(pieces, _translated), ""))


def _translated(piece: Column, i: Column) -> Column:
    """A piece behind a mark, its first character as a digit; the piece before the first mark as it is."""
    return F.when(i == 0, piece).otherwise(F.concat(F.translate(F.substring(piece, 1, 1), OCR_LETTERS, OCR_DIGITS), piece.substr(F.lit(2), F.length(piece))))


def _cut_tail(marked: Column) -> Column:
    """Without the unmarked letters at the end (a marked one is mark and letter)."""
    return F.regexp_replace(marked, rf"(?:(?<!{_MARK})[{OCR_LETTERS}])+$", "")


def normalize_block(block: Column) -> Column:
    """One block of digits as the registry writes it: masked, as punctuated, or grouped."""

    def written(text: Column, only: Column) -> Column:
        punctuated = F.regexp_replace(text, r"[ \n\r\t\xa0]", "")
        return F.when(F.length(only) == 20, mask_unified(only)).when(text.rlike(r"[.\-]"), punctuated).otherwise(group_thousands(only))

    clean = block.rlike(r"^[0-9](?:[0-9.\-]*[0-9])?$")  # nothing to trim or translate
    return bind(F.when(clean, block).otherwise(_trimmed_and_translated(block)), lambda text: bind(digits(text), lambda only: written(text, only)))


def identifiers(snippet: Column) -> Column:
    """array<string>: the normalised identifiers of a snippet, in order.

    Blocks without a digit, years behind a preposition, region numbers of
    courts, single digits and, where there are other blocks, bare years are
    left out.
    """
    none = F.array().cast("array<string>")
    years = F.when(F.contains(snippet, F.lit("19")) | F.contains(snippet, F.lit("20")), F.regexp_extract_all(snippet, F.lit(r"(?iU)\b(?:de|em)\s+((?:19|20)[0-9]{2})\b"), F.lit(1))).otherwise(none)
    regions = F.when(snippet.rlike("(?i)tr[fte]|cjf|jef"), F.regexp_extract_all(snippet, F.lit(r"(?iU)\b(?:TRF|TRT|TRE|CJF|JEF)\s*-?\s*([0-9]{1,2})\b"), F.lit(1))).otherwise(none)
    blocks = F.filter(F.regexp_extract_all(snippet, F.lit(BLOCK), F.lit(0)), lambda b: b.rlike("[0-9]"))
    read = F.transform(blocks, lambda b: bind(normalize_block(b), lambda n: F.struct(n.alias("n"), digits(n).alias("d"))))
    found = bind(F.array_union(years, regions), lambda gone: F.filter(read, lambda x: ~F.array_contains(gone, x["d"])))
    bare = r"^(?:19|20)[0-9]{2}$"
    return bind(found, lambda all_: F.transform(F.filter(all_, lambda x: (F.length(x["d"]) >= 2) & ~((F.size(all_) > 1) & x["d"].rlike(bare))), lambda x: x["n"]))
