"""Text and number standardisation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words that mean a missing value in text columns.
NULL_WORDS = ("", "nan", "None", "<NA>")
#: Letters whose compatibility decomposition is one ASCII letter or digit and marks, up to U+024F.
_FOLDS = {
    c: d
    for c in map(chr, range(0xA0, 0x250))
    if len(d := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and d.isascii()
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_parts(c: str | Column) -> Column:
    """``c`` itself, by way of an array of one element: a projection that holds this is compiled in several methods.

    Spark compiles other projections into one method, and the JVM never compiles one of over 8,000 bytes of code: it interprets
    it row by row. To be used once in a projection of many texts.
    """
    return F.get(F.transform(F.array(col(c)), lambda x: x), F.lit(0))


def strip_accents(c: str | Column) -> Column:
    """Compatibility letters without their marks; loose combining marks go as well."""
    folded = F.translate(col(c), "".join(_FOLDS), "".join(_FOLDS.values()))
    plain = F.octet_length(col(c)) == F.length(col(c))  # ASCII alone
    return F.when(plain, col(c)).otherwise(F.regexp_replace(folded, "[\\u0300-\\u036f]", ""))


def _odd_blanks(c: Column) -> Column:
    """Whether a text has two blanks on end or other white space; only such texts need a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in ("  ", "\t", "\n", "\r", "\x0b", "\f")])


def collapse(c: Column) -> Column:
    return F.trim(F.when(_odd_blanks(c), F.regexp_replace(c, r"\s+", " ")).otherwise(c))


def normalize_text(c: str | Column) -> Column:
    """Lower case, no accents, anything but a-z and 0-9 is one blank; null is empty."""
    plain = strip_accents(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def upper_text(c: str | Column) -> Column:
    """Upper case, no accents, single blanks; punctuation stays; null is empty."""
    return collapse(F.upper(strip_accents(F.coalesce(col(c), F.lit("")))))


def _unless_null_word(text: Column) -> Column:
    # a length tells most texts from words for null
    return F.when((F.length(text) > max(map(len, NULL_WORDS))) | ~text.isin(*NULL_WORDS), text)


def clean_text(c: str | Column) -> Column:
    """Line ends and runs of blanks are one blank; words for null are null."""
    text = col(c).cast("string")
    return _unless_null_word(F.trim(F.when(_odd_blanks(text), F.regexp_replace(text, r"\s{2,}|[\r\n\t]", " ")).otherwise(text)))


def present(c: str | Column) -> Column:
    """Trimmed text, null where it stands for a missing value."""
    return _unless_null_word(F.trim(col(c).cast("string")))


def has_word(text: Column, term: str) -> Column:
    quoted = "\\Q" + term + "\\E"
    return F.rlike(text, F.lit(rf"(?<!\w){quoted}(?!\w)"))


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def _amount(c: str | Column, plain) -> Column:
    """The number that ``plain`` leaves of amount text without blanks and currency; bound to names, so that each text is made once."""
    text = F.translate(F.replace(col(c).cast("string"), F.lit("R$"), F.lit("")), " \t\n\r\x0b\f", "")
    return F.get(F.transform(F.transform(F.array(text), plain), _number), F.lit(0))


def parse_decimal(c: str | Column) -> Column:
    """Amount text as double. Of both marks the last is the decimal one, a lone comma is it too; else null."""

    def plain(text: Column) -> Column:
        comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
        last_comma = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
        return (
            F.when(comma & dot & last_comma, F.translate(F.translate(text, ".", ""), ",", "."))
            .when(comma & dot, F.translate(text, ",", ""))
            .when(comma, F.translate(text, ",", "."))
            .otherwise(text)
        )

    return _amount(c, plain)


def parse_decimal_comma(c: str | Column) -> Column:
    """Amount text in which, if both marks occur, dots part thousands and the comma is decimal."""
    return _amount(c, lambda text: F.when(F.contains(text, F.lit(",")), F.translate(F.translate(text, ".", ""), ",", ".")).otherwise(text))


#: Words for true and false.
TRUE_WORDS = ("true", "1", "sim", "yes", "y")


def parse_bool(c: str | Column) -> Column:
    """True for a word that means yes, else false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def labelled(code: str | Column, text: str | Column, default: str) -> Column:
    return F.concat(col(code).cast("string"), F.lit(" - "), F.coalesce(clean_text(text), F.lit(default)))
