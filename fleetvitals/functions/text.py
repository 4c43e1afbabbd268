"""Statement text and the numbers written into findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import canonical_statement

# Patterns over statement text (fixed values).
OPERAND_NUMBER = r"(= |\()[0-9]+"
WILDCARD_SEARCH = r"(?i)\bI?LIKE\s+'%[^']+%'"
WILDCARD_ILIKE = r"(?i)\bILIKE\s+'%[^']+%'"


def fingerprint(sql_text: Column, literals: str = "operands") -> Column:
    """Statement text with its literals replaced by ``$1``.

    ``operands`` replaces integers after ``= `` or ``(`` only, so string
    literals stay readable; ``all`` gives the canonical text: every string, number and
    parameter is replaced, a list of them by one, and comments and layout go.
    """
    if literals == "operands":
        return F.regexp_replace(sql_text, OPERAND_NUMBER, r"$1\$1")
    if literals == "all":
        return canonical_statement(sql_text)
    raise ValueError(f"literals must be 'operands' or 'all', not {literals!r}")


def query_id(query: Column) -> Column:
    """A stable id of a normalised statement."""
    return F.md5(query)


def statement_key(sql_text: Column) -> Column:
    """What texts of one statement share, however their literals and parameters are written."""
    return F.md5(fingerprint(sql_text, "all"))


def is_wildcard_search(sql_text: Column) -> Column:
    return sql_text.rlike(WILDCARD_SEARCH)


def is_wildcard_ilike(sql_text: Column) -> Column:
    return sql_text.rlike(WILDCARD_ILIKE)


def _digits(value: Column) -> Column:
    """A number by its decimal digits, so that 64.055 rounds as written; null beyond them."""
    return value.try_cast("decimal(38,10)")


def rounded(value: Column, digits: int = 2) -> Column:
    """Rounding half away from zero, as the server rounds NUMERIC."""
    return F.round(_digits(value), digits).cast("double")


def fixed(value: Column, digits: int = 2) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.round(_digits(value), digits).try_cast(f"decimal(38,{digits})").cast("string")


def grouped(value: Column) -> Column:
    """A whole number as text with thousands separators."""
    return F.format_number(value.cast("bigint"), 0)


def quoted(value: Column) -> Column:
    """A value as an SQL string literal."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
